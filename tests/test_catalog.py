"""Every catalog query runs, and equals its SQL."""

import glob
import os

import pytest

from loomlink.plans.catalog import QUERIES, SQL

#: Fitted models take a while; they have their own tests.
SLOW = {"oof_scores", "fold_averages", "stage1_pruned", "stage2_scores", "stage4_choice"}


def plain(rows):
    fix = lambda x: round(x, 4) + 0.0 if isinstance(x, float) else str(x)[:19] if hasattr(x, "year") else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert plain(got) == plain([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])


@pytest.mark.parametrize("name", ["pair_features", "pair_features_finer", "ratio_similarity", "edit_similarity_cands"])
def test_features_cover_the_candidates(spark, data, name):
    """One row for every different pair of ``cands`` with both records, not only for the labelled ones."""
    gids = spark.read.parquet(f"{data}/prepared.parquet").select("gid")
    pairs = spark.read.parquet(f"{data}/cands.parquet").select("s1", "rid").dropna().distinct()
    pairs = pairs.join(gids.withColumnRenamed("gid", "s1"), "s1").join(gids.withColumnRenamed("gid", "rid"), "rid").select("s1", "rid")
    df = QUERIES[name](spark, data)
    got = sorted(map(tuple, df.select("s1", "rid").collect()))
    assert got == sorted(map(tuple, pairs.collect()))
    if "cmp_n_cand_s1" in df.columns:
        per = {r["s1"]: r["count"] for r in pairs.groupBy("s1").count().collect()}
        assert all(r["cmp_n_cand_s1"] == per[r["s1"]] for r in df.select("s1", "cmp_n_cand_s1").collect())
