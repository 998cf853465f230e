"""The queries over the test tables equal their SQL, and keep their conditions."""

import glob
import os

import pytest

from loomlink.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    fix = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(fix(r) for r in df.select(*names).collect()) == sorted(map(fix, found.fetchall()))


@pytest.mark.parametrize("name", ["p1_found", "p3_found"])
def test_pairs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == ["gid_a", "gid_b"] and df.where("gid_a >= gid_b").count() == 0
    assert df.count() == df.distinct().count() > 0


def test_one_place_each(spark, data):
    df = QUERIES["p4_found"](spark, data)
    assert df.columns == ["s1", "rid"] and df.count() == df.select("rid").distinct().count() > 0
    assert df.where("s1 not like 'S1-%' or rid like 'S1-%'").count() == 0


def test_containers(spark, data):
    df = QUERIES["p7_containers"](spark, data)
    assert df.groupBy("container").sum("n_tokens").where("`sum(n_tokens)` > 512").count() == 0
