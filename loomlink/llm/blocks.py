"""Comparing the rows of a block with each other, over sorted partitions and in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.session import cut


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows in the same block, the rows lying block after block."""
    ends = np.cumsum(sizes)
    start_of = np.repeat(ends - sizes, sizes)
    later = np.repeat(ends, sizes) - np.arange(len(start_of)) - 1
    left = np.repeat(np.arange(len(start_of)), later)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
    return left, right


def whole_blocks(batches: Iterator[pd.DataFrame], key: str, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of some ``rows`` rows of a partition sorted by ``key``, no block cut in two."""
    held, size = [], 0
    for df in batches:
        if df.empty:
            continue
        held.append(df)
        size += len(df)
        if size < rows:
            continue
        all_rows = pd.concat(held, ignore_index=True) if len(held) > 1 else df
        k = all_rows[key].to_numpy()
        end = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if end:
            yield all_rows.iloc[:end].reset_index(drop=True)
        held, size = [all_rows.iloc[end:]], len(all_rows) - end
    if held:
        yield pd.concat(held, ignore_index=True)


def compare_blocks(verify: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray], key: str, row: str, at_once: int = 400_000):
    """A mapper of sorted partitions: pairs of ``row`` values, the smaller first, that ``verify`` accepts.

    ``verify(frame, left, right)`` gives a mask over pairs of places in the frame. Rows of a block with an equal ``part``
    of 0 or more are not compared, see ``in_chunks``.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in whole_blocks(batches, key):
            k = df[key].to_numpy()
            starts = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
            sizes = np.diff(starts, append=len(k))
            ids, part = df[row].to_numpy(), df["part"].to_numpy()
            # Blocks in groups of bounded numbers of pairs.
            load = np.cumsum(sizes * (sizes - 1) // 2) // at_once
            out = []
            for g in np.unique(load):
                m = np.flatnonzero(load == g)
                a = starts[m[0]]
                left, right = pairs_within(sizes[m])
                if not len(left):
                    continue
                left, right = left + a, right + a
                apart = (part[left] < 0) | (part[left] != part[right])
                left, right = left[apart], right[apart]
                x, y = ids[left], ids[right]
                lo, hi = np.minimum(x, y), np.maximum(x, y)
                # A pair met in several blocks of this frame is compared once.
                order = np.lexsort((hi, lo))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
                pick = order[fresh]
                pick = pick[lo[pick] != hi[pick]]
                ok = verify(df, left[pick], right[pick])
                out.append((lo[pick][ok], hi[pick][ok]))
            if out:
                yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})

    return work


def in_chunks(rows: DataFrame, row: str, most: int) -> DataFrame:
    """``rows`` and ``part``, every ``block`` of more than ``most`` rows cut by the hash of ``row`` into chunks of half as many.

    Every two chunks, and every chunk for itself, are a block of their own, so that all rows of a block still meet, each
    two once. ``part`` is the chunk where two chunks meet, else -1.
    """
    common = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    common = cut(common.select("block", F.ceil(F.col("n") * 2 / most).cast("int").alias("chunks")))
    calm = rows.withColumn("part", F.lit(-1))
    if common.isEmpty():
        return calm
    own, other = F.col("own"), F.col("other")
    hot = rows.join(common, "block").withColumn("own", F.pmod(F.xxhash64(F.col(row)), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    hot = hot.withColumn("block", F.xxhash64("block", F.least(own, other), F.greatest(own, other))).withColumn("part", F.when(own == other, -1).otherwise(own))
    return calm.join(common, "block", "left_anti").unionByName(hot.drop("chunks", "own", "other"))


def across_chunks(rows: DataFrame, row: str, side: str, most: int) -> DataFrame:
    """``rows``, every ``block`` of more than ``most`` rows cut, by the hash of ``row``, into chunks of the rows of which the boolean ``side`` is true and of the others.

    Every chunk of one side makes a block with every chunk of the other, so that each two rows of different sides of a block meet once.
    """
    there = F.count_if(F.col(side))
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n * 2 / most)).cast("int")
    common = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), there.alias("there")).where(F.col("n") > most)
    common = cut(common.select("block", chunks(F.col("there")).alias("mine"), chunks(F.col("n") - F.col("there")).alias("theirs")))
    if common.isEmpty():
        return rows
    mine, theirs, own, other = map(F.col, ("mine", "theirs", "own", "other"))
    hot = rows.join(common, "block").withColumn("own", F.pmod(F.xxhash64(row), F.when(F.col(side), mine).otherwise(theirs)).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col(side), theirs).otherwise(mine) - 1)))
    hot = hot.withColumn("block", F.xxhash64("block", F.when(F.col(side), own).otherwise(other), F.when(F.col(side), other).otherwise(own)))
    return rows.join(common, "block", "left_anti").unionByName(hot.drop("mine", "theirs", "own", "other"))
