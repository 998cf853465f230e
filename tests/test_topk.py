"""The top-k join of texts against the plain join of postings, and what it moves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlink.operators import blocking, topk
from loomlink.plans.catalog import QUERIES


def odd_records(n=160):
    rnd = random.Random(4)
    words = ["fipotas", "vakisti", "pharmacy", "दुकान", "ફાર્માક્ય", "a", "12", "main", "street", "𝒳𝒴𝒵", "aaaaaaaa", "kedrade"]
    rows = []
    for i in range(n):
        name, addr = ((s.join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))) for s in ("", rnd.choice([" ", "  "])))
        rows.append((2**60 + i, rnd.choice([1, 2, 3]), rnd.choice(["x", "y", "z y"]), rnd.choice([name, name, name, "", None, "ab"]), rnd.choice([addr, addr, addr, "", None])))
    return rows + [(1, 1, None, "pharmacy", "12 main"), (None, 2, "x", "pharmacy", "12 main"), (5, 2, "only others", "pharmacyvakisti", "main street"), (6, 3, "only others", "pharmacyfipotas", "main street")]


SCHEMA = "gid long, src int, country string, name_key string, addr_roman string"


def plain_retrieve(df, k):
    """By joins of all postings."""
    df = df.where("gid is not null and country is not null")
    name, addr = blocking.postings(df, "gid", "name_key", "country"), blocking.postings(df, "gid", "addr_roman", "country", in_words=True)
    side = df.select("gid", (F.col("src") == 1).alias("listed"), (F.col("addr_roman") == "").alias("blank"))
    out = []
    for r, n in k.items():
        v = {"addr": addr, "comb": blocking.combined_postings(name, addr), "blank": name}[r.split("_")[0]].join(side, "gid")
        ends = [v.where("listed"), v.where("not listed and blank" if r.startswith("blank") else "not listed")]
        q, i = ends if r.endswith("fwd") else ends[::-1]
        got = blocking.topk_join(q, i, n, "country", "gid", "gid").collect()
        out += [(*((x["q"], x["i"]) if r.endswith("fwd") else (x["i"], x["q"])), r, round(x["score"], 5), x["rank"]) for x in got]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 1 << 18), (20, 9)])
def test_retrieve_equals_the_join_of_postings(spark, monkeypatch, sizes):
    monkeypatch.setattr(blocking, "QUERIES_AT_ONCE", sizes[0])
    monkeypatch.setattr(blocking, "INDEX_AT_ONCE", sizes[1])
    # df = N / 2 and df = 1 are limits, so a record less or more would show; gids beyond 2^53 are no doubles
    df = spark.createDataFrame(odd_records(), SCHEMA)
    k = {"addr_fwd": 4, "comb_fwd": 5, "blank_fwd": 3, "comb_rev": 2}
    got = sorted((r["s1"], r["rid"], r["retriever"], round(r["score"], 5), r["rank"]) for r in blocking.retrieve(df, k).collect())
    assert got and got == plain_retrieve(df, k)


def test_bounds_drop_no_row():
    """Every limit of the search forced: many equal scores, cuts that leave too much, several levels and batches."""
    rnd = random.Random(7)
    syllables = ["".join(rnd.choice("bcdfglmnprstv") + rnd.choice("aeiou") for _ in range(2)) for _ in range(60)]
    ends = ["pharmacy", "logistics", "hardware", "electronics"]
    texts = ["".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) + rnd.choice(ends) for _ in range(3000)]
    row, code = topk.gram_codes(texts, False)
    codes, df = np.unique(np.unique(np.stack([row, code]), axis=1)[1], return_counts=True)
    grams = topk.Grams(np.zeros(len(codes), int), codes, np.log((1 + len(texts)) / (1 + df)) + 1)
    dense = np.zeros((len(texts), grams.n))
    row, rank, w = grams.vectors([texts], [False])
    dense[row, rank] = w
    for k, at_once in ((1, 9999), (3, 9999), (3, 700), (50, 9999), (50, 700), (2499, 9999), (4000, 700)):
        asked = texts[2500:] if k < 100 else texts[2500:2520]
        want = np.floor(dense[2500 : 2500 + len(asked)] @ dense[:2500].T * 1e4 + 0.5) / 1e4
        q, i, score, rank = topk.top(grams, [asked], [texts[:2500]], [False], k, 4, at_once)
        for j in range(len(asked)):
            order = np.lexsort((np.arange(2500), -want[j]))[:k]
            order = order[want[j][order] > 0]
            own = q == j
            assert i[own].tolist() == order.tolist() and rank[own].tolist() == list(range(1, len(order) + 1))
            assert score[own] == pytest.approx(want[j][order], abs=1e-9)


def shuffled(spark, run):
    """Rows that the shuffles of ``run`` wrote."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(j).shuffleWriteRecords() for j in range(stages.size()))

    before = total()
    run()
    return total() - before


def crowd(n=300):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bcdfg") + rnd.choice("aeiou") for _ in range(5))
    return [(i, 1 + i % 3, "x", word() + "pharmacy"[: 3 + i % 6], f"{word()} {'street road avenue'.split()[i % 3]}") for i in range(n)]


def test_retrieve_moves_no_pairs(spark):
    df = spark.createDataFrame(crowd(), SCHEMA)
    assert shuffled(spark, lambda: blocking.retrieve(df).collect()) < 20_000


def test_topk_name_join_moves_no_pairs(spark, tmp_path):
    spark.createDataFrame(crowd(), SCHEMA).write.parquet(str(tmp_path / "prepared.parquet"))
    assert shuffled(spark, lambda: QUERIES["topk_name_join"](spark, str(tmp_path)).collect()) < 5_000


def test_retrieve_searches_in_the_jvm(spark, monkeypatch):
    """Many small chunks of the index, each with the floor of those before it, and no Python for pairs."""
    monkeypatch.setattr(blocking, "ROWS_AT_ONCE", 30)
    df = spark.createDataFrame(crowd(), SCHEMA)
    k = {"addr_fwd": 7, "comb_fwd": 7, "comb_rev": 2}
    found = blocking.retrieve(df, k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapPartitions" in plan and "Arrow" not in plan and "Pandas" not in plan
    got = sorted((r["s1"], r["rid"], r["retriever"], round(r["score"], 5), r["rank"]) for r in found.collect())
    assert got == plain_retrieve(df, k)
