"""A run from tab-separated lists to result lists, and its parts."""

import random

import pytest
from pyspark.sql import functions as F

from loomlink.operators import decide, features, metric, models, prepare, sampling
from loomlink.plans.linkage import Run, build_candidates
from loomlink.sources import files
from loomlink.sources.files import LinkConfig


def lists(folder, split, n, rnd):
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    rows, truth = {1: [], 2: [], 3: []}, []
    for k in range(n):
        a, b, street, country = word(), word(), word(), ("US", "France")[k % 2]
        rows[1].append((f"S1-{k}", f"{a} {b} foods inc", f"{k + 1} {street} street", country))
        mine = []
        for src in (2, 3):
            if rnd.random() < 0.7:
                rows[src].append((f"S{src}-{k}", f"{a.upper()} {b} foods", f"{k + 1} {street} st", country))
                mine.append(f"S{src}-{k}")
            rows[src].append((f"S{src}-x{k}", f"{a} {word()} motors", f"{k + 7} {word()} road", country))
        truth.append((f"S1-{k}", ",".join(mine)))
    for i, r in rows.items():
        (folder / f"{split}_source{i}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(x) + "\n" for x in r))
    return truth


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("lists")
    rnd = random.Random(1)
    truth = lists(f, "train", 60, rnd)
    (f / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    want = lists(f, "test", 30, rnd)
    return f, dict(want)


def test_run_from_lists(spark, folder):
    f, want = folder
    config = LinkConfig(str(f), str(f / "work"), str(f / "out"), kind="lr", stage1_share=1.0, retrievers={"addr_fwd": 10, "comb_fwd": 10, "blank_fwd": 5, "comb_rev": 3})
    run = Run.from_lists(spark, config)
    pairs = run.predict()
    found = files.to_entity_ids(pairs, run.records["test"]).collect()
    got = {}
    for r in found:
        got.setdefault(r["s1"], set()).add(r["rid"])
    right = sum(len(got.get(s, set()) & set(m.split(","))) for s, m in want.items())
    assert right >= 0.9 * sum(bool(x) for m in want.values() for x in m.split(",")) and right >= 0.9 * sum(map(len, got.values()))
    scores = run.scores("train", 4)
    assert scores.count() == run.features("train").count() and scores.where("p < 0 or p > 1 or p is null").count() == 0
    results = {r["rule"]: r for r in run.evaluate().collect()}
    assert set(results) == set(config.rules) and all(0 <= r["macro_f05"] <= 1 for r in results.values())
    assert run.rule() == max(sorted(results), key=lambda r: results[r]["mixed_f05"])
    assert run.report().where("level = 'all'").count() == 1
    # What is written passes the checks, and a second run reads every step and every model.
    matches = files.read_tsv(spark, config.result("matching_results"), "source1_entity_id string, matched_entity_ids string")
    all_s1 = run.records["test"].where("src = 1").select(F.col("entity_id").alias("s1"))
    assert metric.check_id_lists(matches, all_s1, run.records["test"]).count() == 0
    again = Run(spark, config, run.records["train"], run.records["test"], run.truth, run.labelled)
    assert sorted(map(tuple, again.predict().collect())) == sorted(map(tuple, pairs.collect()))
    fitted, columns = again.models("stage4")
    assert len(fitted) == 3 and columns == features.stack_features(4)
    assert files.values_of(spark, config.step("train_prepared"), "country") == ["France", "US"]
    assert files.entity_ids(spark, config.source("test", 1)).count() == 30


def test_candidates_of_a_sample_and_the_rest(spark, folder):
    f, _ = folder
    config = LinkConfig(str(f), "", "", retrievers={"comb_fwd": 2}, fraction=0.4)
    records = prepare.prepared(files.union_sources([files.read_tsv(spark, config.source("test", i)) for i in (1, 2, 3)]), spark.createDataFrame([], "ind string, lat string"))
    ids = [{r["s1"] for r in build_candidates(records, LinkConfig(str(f), "", "", retrievers={"comb_fwd": 2}, fraction=0.4, rest=rest)).select("s1").collect()} for rest in (False, True)]
    assert ids[0] and ids[1] and not ids[0] & ids[1]


def test_prepared(spark):
    rows = [("S1-1", "Cénter Shop Ltd", "12 Main St", "US", 1), ("S2-1", "दुकान abc", None, None, 2), ("S2-2", "Limited", "", "", 2), ("S2-2", "Limited", "", "", 2), (None, "x", "", "", 2)]
    df = spark.createDataFrame(rows, "entity_id string, name string, addr string, country string, src int").withColumn("extra", F.lit(1))
    got = {r["entity_id"]: r for r in prepare.prepared(df, spark.createDataFrame([("दुकान", "dukan")], "ind string, lat string")).collect()}
    assert set(got) == {"S1-1", "S2-1", "S2-2"} and got["S1-1"]["name_key"] == "centershop" and got["S1-1"]["addr_nums"] == "12"
    assert got["S2-1"]["name_roman"] == "dukan abc" and got["S2-1"]["n_indic_unknown"] == 0 and got["S2-2"]["name_key"] == "limited"
    none = prepare.prepared(df, spark.createDataFrame([], "ind string, lat string"))
    assert none.where("entity_id = 'S2-1'").first()["n_indic_unknown"] == 1


def test_early_stopping_and_stored_models(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(s, r, x, int(x + rnd.random() > 1.0), True, 1.0) for s in range(60) for r in range(4) for x in [rnd.random()]]
    df = spark.createDataFrame(rows, "s1 bigint, rid bigint, x double, label int, keep boolean, weight double")
    scored, fitted, rounds = models.cross_validate(df, ["x"], seeds=2, rounds=5)
    assert scored.count() == len(rows) and len(fitted) == 6 and 1 <= rounds <= 5
    models.save_models(spark, fitted[:1], ["x"], str(tmp_path / "m"))
    loaded, columns = models.load_models(spark, str(tmp_path / "m"))
    a, b = (models.apply_models(m, df, columns).select("s1", "rid", F.round("p", 9).alias("p")) for m in (fitted[:1], loaded))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert models.final_fit(df.withColumn("label", F.lit(0)), ["x"], 3) is None


def test_small_parts(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 100).alias("s1"), F.col("id").alias("rid"), (F.col("id") / 2000).alias("p"))
    part = sampling.capped_by_key(df, "s1", 500)
    assert 200 < part.count() < 900 and part.groupBy("s1").count().where("count <> 20").count() == 0
    assert sampling.capped_by_key(df, "s1", 5000).count() == 2000
    assert [r["rid"] for r in sampling.in_order(df, "s1", "rid").limit(3).collect()] == [0, 100, 200]
    assert df.where(features.between_bands("p", (0.001, 0.999), (0.01, 0.99))).count() == 36
    keep = decide.cut_candidates(df, df.withColumnRenamed("p", "p1"), 0.5)
    assert keep.count() == 1000
    a, b = (spark.createDataFrame([(1, 1, "US", p), (2, 2, "France", p), (3, 3, None, p)], "s1 bigint, rid bigint, country string, p double") for p in (0.1, 0.9))
    assert {(r["s1"], r["p"]) for r in decide.merge_by_country(a, b, ["France"]).collect()} == {(1, 0.9), (2, 0.1), (3, 0.9)}
    for name, column in (("f1", "x"), ("f2", "v2_y")):
        df.limit(5).withColumn(column, F.lit(1)).write.parquet(str(tmp_path / name))
    assert files.load_features(spark, str(tmp_path / "f1"), str(tmp_path / "f2"), ["x", "v2_y"]).columns == ["s1", "rid", "x", "v2_y"]
    n = []
    build = lambda: n.append(1) or df.limit(3)
    for _ in range(2):
        files.cached(spark, str(tmp_path / "c"), build, after=(str(tmp_path / "f1"),))
    assert len(n) == 1
    df.limit(5).write.mode("overwrite").parquet(str(tmp_path / "f1"))
    files.cached(spark, str(tmp_path / "c"), build, after=(str(tmp_path / "f1"),))
    assert len(n) == 2
