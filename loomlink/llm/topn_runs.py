"""The N best items of every group, by merging sorted runs with a loser tree.

Plan: the scored pairs are spread by a hash of the whole pair, so no group, however large, lies in
one task. Every task sorts its share (JVM, with spill) by bucket, group, score and item, keeps the
first N of each group (nothing later in a run can be among the N best) and stores it as runs:
chunks of packed arrays, each with its first key. The chunks of a bucket come to one task in the order of their
first keys (sorted by the JVM, with spill), so that the task can merge the runs as a stream: it holds only the chunks
that have begun and not ended. It merges them with a tree of losers; once N items of a group are out, every run
seeks to its next group. The number of buckets should grow with the rows.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = "bucket int, first_group bigint, first_score double, first_item bigint, run bigint, groups binary, scores binary, items binary"
_CHUNK_ROWS, _OUT_ROWS = 8192, 50_000


class LoserTree:
    """Tournament over the heads of ``k`` runs; the inner nodes hold the losers, node 0 the winner."""

    def __init__(self, heads: list[tuple]):
        self.heads = heads
        self.k = len(heads)
        self.nodes = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._enter(leaf)

    def _enter(self, leaf: int) -> None:
        at, winner = (leaf + self.k) // 2, leaf
        while at > 0:
            if self.nodes[at] < 0:
                self.nodes[at] = winner
                return
            if self.heads[self.nodes[at]] < self.heads[winner]:
                self.nodes[at], winner = winner, self.nodes[at]
            at //= 2
        self.nodes[0] = winner

    @property
    def winner(self) -> int:
        return self.nodes[0]

    def replace(self, leaf: int, head: tuple) -> None:
        """New head of the run that just won."""
        heads, nodes = self.heads, self.nodes
        heads[leaf] = head
        at, winner = (leaf + self.k) // 2, leaf
        while at > 0:
            if heads[nodes[at]] < heads[winner]:
                nodes[at], winner = winner, nodes[at]
            at //= 2
        nodes[0] = winner


_END = (2, 0, 0.0, 0)


class Run:
    """A sorted run that comes in chunks ``(groups, scores, items)``; its head is the next row that has come."""

    def __init__(self):
        self.chunks: deque[tuple] = deque()
        self.at = self.size = 0

    def add(self, groups: np.ndarray, scores: np.ndarray, items: np.ndarray) -> None:
        self.chunks.append((groups, scores, items))
        if self.at == self.size:
            self._open()

    def _open(self) -> None:
        self.at = self.size = 0
        if self.chunks:
            g, s, i = self.chunks.popleft()
            stops = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
            self.ends = np.repeat(stops, np.diff(stops, prepend=0)).tolist()
            self.groups, self.scores, self.items, self.size = g.tolist(), s.tolist(), i.tolist(), len(g)

    def head(self) -> tuple:
        p = self.at
        return (1, self.groups[p], -self.scores[p], self.items[p]) if p < self.size else _END

    def step(self, seek: bool) -> None:
        """To the next row, or to the next group."""
        self.at = self.ends[self.at] if seek else self.at + 1
        if self.at >= self.size:
            self._open()


class RunMerger:
    """Merges runs whose chunks come in the order of their first keys; what is below a new chunk's first key can go out before it.

    Runs that begin, or go on after they had ended for now, wait in a small heap beside the tree, which takes them in
    when they have become many.
    """

    def __init__(self, n: int):
        self.n, self.runs, self.tree, self.beside = n, {}, LoserTree([]), []
        self.leaves: list[int] = []
        self.group, self.taken = None, 0

    def add(self, run: int, groups: np.ndarray, scores: np.ndarray, items: np.ndarray) -> None:
        r = self.runs.setdefault(run, Run())
        ended = r.at == r.size
        r.add(groups, scores, items)
        if ended:
            heapq.heappush(self.beside, (*r.head(), run))
            if len(self.beside) > 16 + len(self.leaves) // 2:
                self.leaves = [k for k, r in self.runs.items() if r.at < r.size]
                self.tree, self.beside = LoserTree([self.runs[k].head() for k in self.leaves]), []

    def until(self, stop: tuple = _END) -> Iterator[tuple[int, int, float, int]]:
        """``(group, item, score, place)`` of the rows below ``stop`` that are among their group's first ``n``."""
        while True:
            best = self.tree.heads[self.tree.winner] if self.leaves else _END
            aside = bool(self.beside) and self.beside[0][:4] < best
            key = self.beside[0][:4] if aside else best
            if key >= stop:
                return
            if key[1] != self.group:
                self.group, self.taken = key[1], 0
            full = self.taken == self.n
            if not full:
                self.taken += 1
                yield key[1], key[3], -key[2], self.taken
            if aside:
                r = self.runs[self.beside[0][4]]
                r.step(full)
                if r.at < r.size:
                    heapq.heapreplace(self.beside, (*r.head(), self.beside[0][4]))
                else:
                    heapq.heappop(self.beside)
            else:
                leaf = self.tree.winner
                r = self.runs[self.leaves[leaf]]
                r.step(full)
                self.tree.replace(leaf, r.head())


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[int, int, float, int]]:
    """``(group, item, score, place)`` of the ``n`` first items of every group of the sorted runs."""
    merger = RunMerger(n)
    for k, run in enumerate(runs):
        if len(run[0]):
            merger.add(k, *run)
    return merger.until()


def _form_runs(n: int):
    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        run, last, before = TaskContext.get().partitionId(), None, 0
        for df in batches:
            if df.empty:
                continue
            bucket, group = df["bucket"].to_numpy(), df["grp"].to_numpy()
            starts = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
            sizes = np.diff(starts, append=len(group))
            place = np.arange(len(group)) - np.repeat(starts, sizes)
            if last == group[0]:
                place[: sizes[0]] += before
            last, before = group[-1], place[-1] + 1
            kept = np.flatnonzero(place < n)
            score, item = df["score"].to_numpy(), df["item"].to_numpy()
            ends = np.append(np.flatnonzero(np.diff(bucket[kept])) + 1, len(kept)) if len(kept) else []
            out, begin = [], 0
            for end in ends:
                for at in range(begin, end, _CHUNK_ROWS):
                    m = kept[at : min(end, at + _CHUNK_ROWS)]
                    out.append((int(bucket[m[0]]), group[m[0]], -score[m[0]], item[m[0]], run, group[m].tobytes(), score[m].tobytes(), item[m].tobytes()))
                begin = end
            yield pd.DataFrame(out, columns=["bucket", "first_group", "first_score", "first_item", "run", "groups", "scores", "items"])

    return form


def _merge(n: int):
    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, float, int]]:
        bucket, merger = None, RunMerger(n)
        for df in batches:
            for row in df.itertuples(index=False):
                if row.bucket != bucket:
                    yield from merger.until()
                    bucket, merger = row.bucket, RunMerger(n)
                yield from merger.until((1, row.first_group, row.first_score, row.first_item))
                merger.add(row.run, *(np.frombuffer(x, t) for x, t in ((row.groups, np.int64), (row.scores, np.float64), (row.items, np.int64))))
        yield from merger.until()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = merged(batches)
        while out := list(islice(rows, _OUT_ROWS)):
            yield pd.DataFrame(out, columns=["grp", "item", "score", "place"])

    return merge


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, buckets: int | None = None) -> DataFrame:
    """The ``n`` rows of each ``group`` with the largest ``score``, ties by smaller ``item``.

    ``df`` holds each (group, item) once. Result: ``group, item, score, place`` (1 is best). Rows with
    a NULL group, item or score, or a NaN score, are left out. An empty input gives an empty result.
    Other columns are dropped. ``group`` and ``item`` are bigint, ``score`` double.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        F.pmod(F.xxhash64(F.col(group).cast("bigint")), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(group).cast("bigint").alias("grp"),
        F.col(score).cast("double").alias("score"),
        F.col(item).cast("bigint").alias("item"),
    ).where("grp is not null and item is not null and score is not null and not isnan(score)")
    runs = rows.sortWithinPartitions("bucket", "grp", F.desc("score"), "item").mapInPandas(_form_runs(n), _RUN)
    order = ["bucket", "first_group", "first_score", "first_item"]
    merged = runs.repartition(buckets, "bucket").sortWithinPartitions(*order).mapInPandas(_merge(n), "grp bigint, item bigint, score double, place int")
    return merged.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "place")


def scored_candidates(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """``s1, rid, p``: the distinct candidate pairs with their largest score that is a number from 0 to 1."""
    pairs = cands.where("s1 is not null and rid is not null").select("s1", "rid").distinct()
    best = (
        scores.where("s1 is not null and rid is not null and p is not null and not isnan(p) and p between 0 and 1")
        .groupBy("s1", "rid")
        .agg(F.max("p").cast("double").alias("p"))
    )
    return pairs.join(best, ["s1", "rid"])
