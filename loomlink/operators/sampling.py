"""Folds and samples that depend on nothing but the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_hash(key: str, seed: int = 0) -> Column:
    """The first 32 bits of an md5 as a number; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")


def fold(key: str, k: int = 3, seed: int = 0) -> Column:
    return (key_hash(key, seed) % k).cast("int")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    return df.where(key_hash(key, seed) < int(fraction * 2**32))


def sample_rest(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """What ``sample_fraction`` leaves."""
    return df.where(key_hash(key, seed) >= int(fraction * 2**32))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(key_hash(key, seed), key).limit(n)


def top_per_group(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def thin_negatives(df: DataFrame, p: str, label: str, keep_one_in: int = 10, below: float = 0.001, seed: int = 7) -> DataFrame:
    """Of the easy negatives one in so many, with that weight; all other rows with weight 1."""
    easy = (F.col(label) == 0) & (F.col(p) < below)
    picked = F.pmod(F.xxhash64(F.lit(seed), "s1", "rid"), F.lit(keep_one_in)) == 0
    return df.where(~easy | picked).withColumn("weight", F.when(easy, float(keep_one_in)).otherwise(1.0))


def capped_by_key(df: DataFrame, key: str, cap: int, seed: int = 3, parts: int = 1000) -> DataFrame:
    """All rows if they are at most ``cap``; else those of a hash slice of the keys that holds about so many, every key with all its rows."""
    n = df.count()
    return df if n <= cap else df.where(key_hash(key, seed) % parts < parts * cap // n)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in one order whatever the plan before, in ranges of the keys: for work in repeatable pieces."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
