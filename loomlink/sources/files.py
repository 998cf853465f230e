"""Tab-separated sources and sinks, labels, cached steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"


@dataclass
class LinkConfig:
    """Where a run reads and writes, and its switches."""

    data: str
    work: str
    out: str
    folds: int = 3
    seed: int = 0
    #: Retrievers and how many candidates each gives a query; the fraction of S1s to take, or the others (``rest``).
    retrievers: dict[str, int] = field(default_factory=lambda: {"addr_fwd": 50, "comb_fwd": 50, "blank_fwd": 30, "comb_rev": 3})
    fraction: float = 1.0
    rest: bool = False
    #: The share of S1s that the first model is fitted on, and how many candidates of each S1 go on.
    stage1_share: float = 0.25
    top: int = 25
    cut: float = 0.0
    #: Model family (``gbt`` or ``lr``), most rounds of boosting, seeds whose models are averaged.
    kind: str = "gbt"
    rounds: int = 20
    seeds: int = 1
    stop_early: bool = True
    #: Rules to choose from, the shares of the countries that weigh the choice, and, if given, the rule to use.
    rules: list[str] = field(default_factory=lambda: [f"greedy{t}" for t in (0.6, 0.65, 0.7, 0.75, 0.8)])
    mix: dict[str, float] = field(default_factory=dict)
    rule: str | None = None
    #: Countries whose scores come from this run; the others' come from the run at ``base``.
    countries: list[str] = field(default_factory=list)
    base: str | None = None

    def source(self, split: str, number: int) -> str:
        return f"{self.data}/{split}_source{number}.tsv"

    def truth(self) -> str:
        return f"{self.data}/train_ground_truth.tsv"

    def step(self, name: str) -> str:
        return f"{self.work}/{name}"

    def result(self, name: str) -> str:
        return f"{self.out}/{name}"


def read_tsv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Tab-separated text, quoting off, every column a string; an empty field is NULL."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", escape="")


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """``entity_id, name, addr, country, src`` of the raw lists, numbered from 1; missing text is empty."""
    out = None
    for i, df in enumerate(sources, 1):
        part = df.select("entity_id", *(F.coalesce(a, F.lit("")).alias(b) for a, b in (("business_name", "name"), ("business_address", "addr"), ("country", "country"))), F.lit(i).cast("tinyint").alias("src"))
        out = part if out is None else out.unionByName(part)
    return out


def union_relaxed(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts; columns that a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def truth_pairs(matches: DataFrame) -> DataFrame:
    """``s1, rid`` of a table of comma lists, each pair once."""
    ids = F.explode(F.split("matched_entity_ids", ","))
    return matches.select(F.col("source1_entity_id").alias("s1"), ids.alias("rid")).select("s1", F.trim("rid").alias("rid")).where("s1 is not null and rid <> ''").distinct()


def id_lists(pairs: DataFrame, all_s1: DataFrame, out: str = "matched_entity_ids") -> DataFrame:
    """One row per ``s1`` of ``all_s1``: its ``rid``s once each, sorted, joined by commas; empty if there are none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.sort_array(F.collect_set("rid")), ",").alias(out))
    return all_s1.select("s1").distinct().join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(out, F.lit("")).alias(out))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, nothing quoted or escaped."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", escapeQuotes=False)


def to_entity_ids(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(s1, rid)`` of row numbers as entity ids, by ``ids(gid, entity_id)``."""
    a, b = ids.select(F.col("gid").alias("s1"), F.col("entity_id").alias("e1")), ids.select(F.col("gid").alias("rid"), F.col("entity_id").alias("e2"))
    return pairs.join(a, "s1").join(b, "rid").select(F.col("e1").alias("s1"), F.col("e2").alias("rid"))


def written_at(spark: SparkSession, path: str) -> int | None:
    """When the table at ``path`` was completed, or None."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(done).getModificationTime() if fs.exists(done) else None


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> DataFrame:
    """The table at ``path``; built and written first if it isn't there complete, or older than a table of ``after``."""
    mine = written_at(spark, path)
    if mine is None or any((written_at(spark, p) or 0) > mine for p in after):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def entity_ids(spark: SparkSession, path: str) -> DataFrame:
    """``entity_id``: the ids in the first column of a tab-separated list."""
    return read_tsv(spark, path).select("entity_id").where("entity_id is not null")


def values_of(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column, from the folders of a table, without reading it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)]
    return sorted(n.partition("=")[2] for n in names if n.startswith(column + "="))


def load_features(spark: SparkSession, first: str, second: str, columns: list[str]) -> DataFrame:
    """``s1, rid`` and the ``columns`` of two feature tables, those that begin with ``v2_`` from the second; only what is wanted is read."""
    keys = ["s1", "rid"]
    other = [c for c in columns if c.startswith("v2_")]
    df = spark.read.parquet(first).select(*keys, *(c for c in columns if c not in other))
    return df.join(spark.read.parquet(second).select(*keys, *other), keys, "left") if other else df


def write_metrics(results: DataFrame, path: str) -> None:
    """Results, a row each, as lines of JSON in one file; they are few."""
    results.coalesce(1).write.mode("overwrite").json(path)
