"""A table of romanisations learned from matched names, and its use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlink.functions.text import INDIC


def aligned_words(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``lat, ind``: words of ``left`` and ``right`` that stand for each other.

    First whole texts with equally many words, place by place; then, of any text, the words of ``left`` that ``right``
    lacks against the Indian words of ``right``, if they are equally many. Both stay inside the row.
    """
    indic = lambda t: t.rlike(INDIC)
    df = pairs.where(F.col(right).rlike(INDIC)).select(F.split(left, " ").alias("l"), F.split(right, " ").alias("r"))
    rest = df.select(F.filter("l", lambda t: ~F.array_contains("r", t)).alias("l"), F.filter("r", indic).alias("r"))
    both = df.unionByName(rest).where((F.size("l") == F.size("r")) & (F.size("l") > 0))
    words = both.select(F.explode(F.arrays_zip("l", "r")).alias("w")).select(F.col("w.l").alias("lat"), F.col("w.r").alias("ind"))
    return words.where(F.col("ind").rlike(INDIC) & ~F.col("lat").rlike(INDIC) & (F.col("lat") != ""))


def learn_table(words: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """``ind, lat, n, tot``: each Indian word's most frequent counterpart, if met ``least`` times and in the ``share`` of its cases; ties by the smaller word."""
    votes = words.groupBy("ind", "lat").agg(F.count(F.lit(1)).alias("n"))
    ind = Window.partitionBy("ind")
    ranked = votes.withColumn("tot", F.sum("n").over(ind)).withColumn("place", F.row_number().over(ind.orderBy(F.desc("n"), "lat")))
    return ranked.where((F.col("place") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("tot"))).select("ind", "lat", "n", "tot")


def add_roman(df: DataFrame, table: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    """``df`` with a romanised copy of each column (old name: new name); only texts with an Indian letter are taken apart.

    The words are looked up by a join, so the table may be of any size. ``key`` is unique.
    """
    for old, new in columns.items():
        words = df.where(F.col(old).rlike(INDIC)).select(key, F.posexplode(F.split(old, " ")).alias("at", "w"))
        found = words.join(table.select(F.col("ind").alias("w"), "lat"), "w", "left")
        text = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("lat", "w").alias("t")))).alias("ws")).select(key, F.array_join(F.col("ws.t"), " ").alias(new))
        df = df.join(text, key, "left").withColumn(new, F.coalesce(new, old))
    return df
