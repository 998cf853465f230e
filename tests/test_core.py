"""Core operators on hand-made cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomlink.functions import similarity as sim
from loomlink.functions import text as tx
from loomlink.operators import blocking, decide, features, metric, models, sampling, translit
from loomlink.sources import files


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios_against_a_table():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc é") for _ in range(rnd.randrange(9))) for _ in "ab")
        want = 200 * lcs_table(a, b) / (len(a) + len(b)) if a or b else 100
        assert sim.ratio_of(a, b) == pytest.approx(want)
        assert sim.ratio_of(a, b) == pytest.approx(sim.ratio_of(b, a))
        assert 0 <= sim.partial_ratio_of(a, b) <= 100
    assert sim.token_sort_ratio_of("b a", "a b") == 100
    assert sim.token_set_ratio_of("a b c", "a b") == 100
    assert sim.token_set_ratio_of("", "a") == 0
    assert sim.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler_of("", "") == 1 and sim.jaro_winkler_of("a", "") == 0
    assert sim.partial_ratio_of("abc", "xxabcxx") == 100


def test_text(spark):
    rows = [(1, "<< Cénter & Sons, L L C", "12 Main St, null"), (2, None, None), (3, "Limited", "0012 Fourth Ave Unit 3"), (4, "कि दुकान Pvt Ltd", "१२ rd"), (5, "shop.com LTD", "")]
    df = tx.add_norm(spark.createDataFrame(rows, "id int, name string, addr string"))
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["name_norm"] == "center and sons l l c" and got[1]["name_key"] == "centerandsons"
    assert got[1]["addr_norm"] == "12 main street" and got[1]["addr_nums"] == "12"
    assert got[2]["name_key"] == "" and got[2]["addr_norm"] == ""
    assert got[3]["name_key"] == "limited"
    assert got[4]["name_norm"].startswith("कि") and got[4]["addr_nums"] == "१२"
    assert got[5]["name_key"] == "shop"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.finer_address(F.lit("po box 12 fourth main unit unit main"))) == "12 4th main"
    assert one(tx.plain_numbers(F.lit("007 7 000 12"))) == "7 0 12"
    assert one(tx.sound_key(F.lit("shreezz"))) == one(tx.sound_key(F.lit("srij")))
    assert one(tx.wordy(F.lit("4th main st"))) == "main st"
    assert one(tx.pin_code(F.lit("x 012345 560001 y"))) == "560001" and one(tx.pin_code(F.lit("12"))) is None


def test_files(spark, tmp_path):
    raw = spark.createDataFrame([("S1-1", 'a "b', None, "US"), ("S1-2", "x", "y", "")], files.RAW)
    files.write_tsv(raw.fillna(""), str(tmp_path / "t"))
    back = files.read_tsv(spark, str(tmp_path / "t"))
    assert sorted((r[0], r[1], r[2]) for r in back.collect()) == [("S1-1", 'a "b', None), ("S1-2", "x", "y")]
    union = files.union_sources([back, back])
    assert union.where("addr = ''").count() == 2 and union.select("src").distinct().count() == 2
    m = spark.createDataFrame([("a", "S2-1, S2-1,S3-2"), ("b", None), ("c", ""), (None, "S2-9")], "source1_entity_id string, matched_entity_ids string")
    t = files.truth_pairs(m)
    assert sorted(map(tuple, t.collect())) == [("a", "S2-1"), ("a", "S3-2")]
    lists = files.id_lists(t, spark.createDataFrame([("a",), ("b",), ("a",)], "s1 string"))
    assert sorted(map(tuple, lists.collect())) == [("a", "S2-1,S3-2"), ("b", "")]
    n = []
    for _ in range(2):
        files.cached(spark, str(tmp_path / "c"), lambda: n.append(1) or raw)
    assert len(n) == 1
    assert metric.check_tsv(spark, str(tmp_path / "none"), ("a",)) == ["missing file"]
    (tmp_path / "bad.tsv").write_text("a,b\n1\t2\t3\n")
    assert metric.check_tsv(spark, str(tmp_path / "bad.tsv"), ("a", "b")) == ["comma instead of tab", "malformed row"]


def test_topk_join_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "A" if i % 3 else "B", "".join(rnd.choice("abcd") for _ in range(rnd.randrange(8)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, c string, t string")
    v = blocking.postings(df, "id", "t", "c")
    vec = {}
    for r in v.collect():
        vec.setdefault((r["c"], r["id"]), {})[r["gram"]] = r["w"]
    for x in vec.values():
        assert sum(w * w for w in x.values()) == pytest.approx(1)
    got = {(r["q"], r["i"]): (r["score"], r["rank"]) for r in blocking.topk_join(v, v, 4, "c", "id", "id").collect()}
    want = {}
    for (c, q), x in vec.items():
        best = sorted((-round(sum(w * y.get(g, 0) for g, w in x.items()), 6), i) for (d, i), y in vec.items() if d == c)
        for k, (s, i) in enumerate([b for b in best if b[0] < 0][:4], 1):
            want[q, i] = (-s, k)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def records(spark):
    rows = [(1, 1, "US", "ab", "1"), (2, 1, "US", "dup", "1"), (3, 1, "US", "dup", "2"), (4, 2, "US", "ab", ""), (5, 2, "FR", "ab", ""), (6, 3, "US", "dup", "2"), (7, 3, "US", "", "")]
    return spark.createDataFrame(rows, "gid bigint, src int, country string, name_key string, addr_nums string")


def test_exact_links(spark):
    assert [tuple(r) for r in blocking.unique_key_link(records(spark)).collect()] == [(1, 4)]
    assert sorted(map(tuple, blocking.exact_pairs(records(spark)).collect())) == [(1, 4), (2, 6), (3, 6)]
    assert sorted(map(tuple, blocking.exact_pairs(records(spark), heavy=1).collect())) == [(1, 4), (3, 6)]


def test_metric_goldens(spark):
    pred = spark.createDataFrame([("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("b", "S3-1")], "s1 string, rid string")
    truth = spark.createDataFrame([("a", "S2-47"), ("a", "S3-812")], "s1 string, rid string")
    per = metric.per_entity_f05(pred, truth, spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string"))
    assert {r["s1"]: round(r["f05"], 7) for r in per.collect()} == {"a": 0.7142857, "b": 0.0, "c": 1.0}
    rep = metric.report(per, spark.createDataFrame([("a", "US"), ("b", "US"), ("c", "FR")], "s1 string, country string"))
    assert {(r["level"], r["value"]): r["n_s1"] for r in rep.collect()} == {("all", ""): 3, ("country", "US"): 2, ("country", "FR"): 1, ("bucket", "0"): 2, ("bucket", "1-3"): 1}
    mixed = metric.mixed_f05(per, spark.createDataFrame([("a", "US"), ("b", "US"), ("c", "FR")], "s1 string, country string"), {"FR": 0.5})
    assert mixed.first()[0] == 1.0


@pytest.mark.parametrize(
    "rows,error",
    [
        ([("a", ""), ("a", ""), ("b", "")], "duplicate_row"), ([("a", "")], "missing_s1"), ([("a", ""), ("b", ""), ("z", "")], "extra_s1"), ([("a", "S2-1,S2-1"), ("b", "")], "duplicate_id"),
        ([("a", "a"), ("b", "")], "self_match"), ([("a", "S9-1"), ("b", "")], "wrong_prefix"), ([("a", "S2-7"), ("b", None)], "unknown_id"),
    ],
)
def test_list_checks(spark, rows, error):
    lists = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    found = metric.check_id_lists(lists, spark.createDataFrame([("a",), ("b",)], "s1 string"), spark.createDataFrame([("S2-1",), ("a",), ("S9-1",)], "entity_id string"))
    assert [r["error"] for r in found.collect() if r["error"] != "wrong_prefix" or error == "wrong_prefix"] == [error]


def test_decisions(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.9), (2, 11, 0.6), (3, 12, 1.0), (3, 13, 0.1)], "s1 bigint, rid bigint, p double")
    run = lambda rule, **k: sorted(map(tuple, decide.apply_rule(df, rule, **k).collect()))
    assert run("thr0.7") == [(1, 10), (2, 10), (3, 12)]
    assert run("greedy0.7") == [(1, 10), (3, 12)]
    assert sorted(map(tuple, decide.select_exclusive(df, 0.7, keep_ties=True).collect())) == [(1, 10), (2, 10), (3, 12)]
    countries = spark.createDataFrame([(1, "FR"), (2, "US"), (3, "US")], "s1 bigint, country string")
    assert run("greedy0.7|FR:0.95", countries=countries) == [(3, 12)]
    assert (3, 12) in run("expF") and (3, 13) not in run("expF")
    with pytest.raises(ValueError):
        decide.apply_rule(df, "what")


def test_expected_f_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(s, r, round(rnd.random(), 3)) for s in range(30) for r in range(rnd.randrange(1, 16))]
    got = {}
    for r in decide.select_expected_f(spark.createDataFrame(rows, "s1 bigint, rid bigint, pn double")).collect():
        got.setdefault(r["s1"], set()).add(r["rid"])
    for s, group in itertools.groupby(rows, key=lambda r: r[0]):
        g = sorted(((-p, r) for _, r, p in group))
        tot, cum, best = -sum(p for p, _ in g), 0.0, (-1, 0)
        for k, (p, _) in enumerate(g[:12], 1):
            cum -= p
            best = max(best, (1.25 * cum / (k + 0.25 * tot), -k))
        none = math.prod(1 + p for p, _ in g)
        assert got.get(s, set()) == ({r for _, r in g[: -best[1]]} if best[0] > none else set())


def test_context(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.4), (2, 10, 0.9), (3, 12, 1.0)], "s1 bigint, rid bigint, p double")
    s = {(r["s1"], r["rid"]): r for r in features.s1_context(df).collect()}
    assert s[1, 10]["s3_second"] == 0.4 and s[3, 12]["s3_second"] == 1.0 and s[1, 11]["s3_rank"] == 2 and s[1, 10]["s3_n_09"] == 1
    r = {(x["s1"], x["rid"]): x for x in features.record_context(df).collect()}
    assert r[1, 10]["r_max_other"] == 0.9 and r[3, 12]["r_max_other"] == 0 and r[2, 10]["r_n_claim"] == 2


def test_romanisation(spark):
    pairs = spark.createDataFrame([("raj foods", "राज foods"), ("raj mill", "राज mill"), ("a b", "only राज"), ("x", None)], "l string, r string")
    t = translit.learn_table(translit.aligned_words(pairs, "l", "r"))
    assert [(x["ind"], x["lat"]) for x in t.collect()] == [("राज", "raj")]
    df = spark.createDataFrame([(1, "राज b राज"), (2, "plain"), (3, None)], "id bigint, t string")
    assert [x["o"] for x in translit.add_roman(df, t, {"t": "o"}, "id").orderBy("id").collect()] == ["raj b raj", "plain", None]


def test_out_of_fold(spark):
    rnd = random.Random(4)
    rows = [(s, r, x, int(x + rnd.random() * 0.4 > 0.7) if r else None if r < 0 else 0) for s in range(60) for r in range(4) for x in [rnd.random()]]
    df = spark.createDataFrame(rows, "s1 bigint, rid bigint, x double, label int")
    scored, fitted = models.oof_score(df, ["x"], kind="lr")
    assert scored.count() == len(rows) and len(fitted) == 3
    assert scored.where("p < 0 or p > 1 or p is null").count() == 0
    assert scored.groupBy("s1").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    again, none = models.oof_score(df.withColumn("label", F.lit(0)), ["x"], kind="lr")
    assert not none and again.select("p").distinct().count() == 1


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = sampling.sample_fraction(df, "k", 0.3), sampling.sample_rest(df, "k", 0.3)
    assert a.count() + b.count() == 1000 and 230 < a.count() < 370 and a.join(b, "k").count() == 0
    assert sampling.sample_n(df, "k", 5).count() == 5
    pairs = spark.range(2000).select(F.col("id").alias("s1"), F.col("id").alias("rid"), F.lit(0.0).alias("p"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    thin = sampling.thin_negatives(pairs, "p", "label")
    assert thin.where("label = 1").count() == 40 and abs(thin.agg(F.sum("weight")).first()[0] - 2000) < 600


def test_stream(spark, tmp_path):
    from loomlink.streaming.linking import link_stream

    arrivals = records(spark).where("src <> 1").select("gid", "country", "name_key")
    arrivals.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).parquet(str(tmp_path / "in"))
    link_stream(stream, records(spark).where("src = 1"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r["s1"], r["rid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 4)]


def test_partial_ratio_against_every_stretch():
    rnd = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc é"[: rnd.randrange(1, 6)]) for _ in range(rnd.randrange(1, 22))) for _ in "ab")
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        m = len(short)
        want = max(sim.ratio_of(short, long[max(0, i) : i + m]) for i in range(1 - m, len(long)))
        if len(a) == len(b):
            want = max(want, max(sim.ratio_of(long, short[max(0, i) : i + m]) for i in range(1 - m, m)))
        assert sim.partial_ratio_of(a, b) == want
