"""Long exact spans shared between records.

Two texts that share a span of ``length`` characters share, in every window of that length, the k-gram with
the least hash (a minimizer). Hashes met in one document only are dropped first, so unique text goes no
further than one pass. Around every other minimizer the stretch that holds all windows with that minimizer is
cut out, equal stretches are put together, and the stretches of one minimizer make a shard. There an
FM-index is built over them, and each stretch is streamed against it by backward search: every span that comes
out is one the index has found, also where whole stretches are equal. A minimizer with very many different
stretches makes several shards, of two chunks each, so that every two of its stretches meet in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlink.llm.blocks import in_chunks
from loomlink.llm.fm_index import FMIndex
from loomlink.session import cut

LENGTH = 100
GRAM = 64
_BATCH_CHARS = 2_000_000
_BLOCK_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _slide(values: np.ndarray, width: int, pick, pad) -> np.ndarray:
    """Running ``pick`` (minimum or maximum) over ``width`` values from each place on."""
    out, have = values, 1
    while have < width:
        by = min(have, width - have)
        moved = np.full(len(values), pad, values.dtype)
        moved[:-by] = out[by:] if by < len(values) else out[:0]
        out, have = pick(out, moved), have + by
    return out


def minimizers(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place in it and hash of every minimizer of the texts' windows of ``length`` characters."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < length:
        return none, none, none
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_INVERSE))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * power[:n])])
    h = (sums[gram:] - sums[:-gram]) * back[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    width = length - gram + 1
    least = _slide(h, width, np.minimum, np.uint64(2**64 - 1))
    ends = np.repeat(np.cumsum(sizes), sizes)
    least = np.where(np.arange(len(h)) + length <= ends[: len(h)], least, np.uint64(0))
    chosen = np.flatnonzero(_slide(least[::-1], width, np.maximum, np.uint64(0))[::-1] == h)
    text = np.repeat(np.arange(len(texts)), sizes)[chosen]
    return text, chosen - (np.cumsum(sizes) - sizes)[text], h[chosen].view(np.int64)


def _gathered(batches: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """The rows of the batches, cut where a frame's texts exceed ``most`` characters."""
    for df in batches:
        sizes = df[column].str.len().to_numpy().cumsum()
        if len(df):
            for _, part in df.groupby(sizes // most, sort=True):
                yield part


def _find_minimizers(length: int, gram: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in _gathered(batches, "text", _BATCH_CHARS):
            text, at, h = minimizers(df["text"].tolist(), length, gram)
            yield pd.DataFrame({"h": h, "doc_id": df["doc_id"].to_numpy()[text], "at": at.astype(np.int32)})

    return find


def _cut_out(length: int, gram: int):
    side = length - gram

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for doc, text, spots in zip(df["doc_id"], df["text"], df["spots"]):
                for s in spots:
                    a = max(0, s["at"] - side)
                    out.append((s["h"], doc, a, text[a : s["at"] + length]))
            yield pd.DataFrame(out, columns=["h", "doc_id", "at", "part"])

    return cut_out


def shared_range(texts: list[str], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text of one minimizer, where its windows that another owner has begin and end (0, 0: none).

    The owner -1 stands for several owners of one text, each of which has another beside it.
    """
    index = FMIndex(texts, owners)
    begin, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    last = index.lengths - length
    asks = np.where(owners == -1, -2, owners)
    live = np.flatnonzero(last >= 0)
    start, found = np.zeros(len(live), np.int64), []
    # From the left: a window that fails at i can only be followed by one that begins behind i.
    while len(live):
        size = index.matched(live, start + length, length, asks[live])
        hit = size == length
        begin[live[hit]] = start[hit]
        found.append(live[hit])
        live, start = live[~hit], (start + length - size)[~hit]
        on = start <= last[live]
        live, start = live[on], start[on]
    live = np.concatenate(found) if found else live
    # From the right, down to the window that is known to be shared.
    start = last[live]
    while len(live):
        size = index.matched(live, start + length, length, asks[live])
        hit = size == length
        end[live[hit]] = start[hit] + length
        live, start = live[~hit], start[~hit] - 1
    return begin, end


def _search(length: int):
    def work(held: list[pd.DataFrame]) -> pd.DataFrame:
        df = pd.concat(held, ignore_index=True)
        begin, end = shared_range(df["stretch"].tolist(), df["owner"].to_numpy(), length)
        out = pd.DataFrame({"h": df["h"], "part_id": df["part_id"], "begin_at": begin.astype(np.int32), "end_at": end.astype(np.int32)})
        return out[end > begin]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for df in batches:
            if df.empty:
                continue
            # Rows come sorted by shard; a frame ends only between two of them.
            if size > _BLOCK_CHARS:
                old = df["block"].to_numpy() == held[-1]["block"].iloc[-1]
                if old.any():
                    held.append(df[old])
                    df = df[~old]
                if len(df):
                    yield work(held)
                    held, size = [], 0
            if len(df):
                held.append(df)
                size += int(df["stretch"].str.len().sum())
        if held:
            yield work(held)

    return search


def shared_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, gather: int = 20_000) -> DataFrame:
    """``doc_id, begin_at, end_at``: the maximal runs of positions that lie in a span of ``length`` characters also in another document.

    Characters are code points counted from 0. Read is ``docs(doc_id, text)``; NULL ids and NULL or shorter texts
    share nothing. Rows with the same ``doc_id`` are one document: the spans of all its texts are reported
    together, and a span that only they share is not shared. ``gather`` bounds the different stretches in a shard's
    index; the stretches of a minimizer that has more are searched in several, with the same result.
    """
    if not length // 2 <= gram < length:
        raise ValueError("gram must be at least half of length, and less than it")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.char_length("text") >= length)
    spots = cut(texts.mapInPandas(_find_minimizers(length, gram), "h bigint, doc_id bigint, at int"))
    met = spots.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
    wanted = spots.join(met, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "at")).alias("spots"))
    places = cut(
        texts.join(wanted, "doc_id").mapInPandas(_cut_out(length, gram), "h bigint, doc_id bigint, at int, part string").withColumn("part_id", F.xxhash64("part"))
    )
    several = F.min("doc_id") != F.max("doc_id")
    parts = places.groupBy("h", "part_id").agg(F.min("part").alias("stretch"), F.when(several, -1).otherwise(F.min("doc_id")).alias("owner"))
    shards = in_chunks(cut(parts.withColumn("block", F.col("h"))), "part_id", gather).select("block", "h", "part_id", "stretch", "owner")
    schema = "h bigint, part_id bigint, begin_at int, end_at int"
    searched = shards.repartition("block").sortWithinPartitions("block").mapInPandas(_search(length), schema)
    # Windows with one and the same minimizer overlap, so what several shards have found of a stretch is one range.
    ranges = searched.groupBy("h", "part_id").agg(F.min("begin_at").alias("begin_at"), F.max("end_at").alias("end_at"))
    found = places.select("h", "part_id", "doc_id", "at").join(ranges, ["h", "part_id"])
    return merge_runs(found.select("doc_id", (F.col("at") + F.col("begin_at")).alias("begin_at"), (F.col("at") + F.col("end_at")).alias("end_at")))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a ``doc_id`` put together; a document's spans are bounded by its length."""
    order = Window.partitionBy("doc_id").orderBy("begin_at", "end_at")
    apart = spans.distinct().withColumn("reach", F.max("end_at").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = F.sum(F.when(F.col("begin_at") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = apart.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("begin_at").alias("begin_at"), F.max("end_at").alias("end_at"))
    return merged.select("doc_id", F.col("begin_at").cast("bigint").alias("begin_at"), F.col("end_at").cast("bigint").alias("end_at"))


def shared_share(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_chars, n_shared, share`` of every document; NULL text has no characters and the share 0."""
    per = spans.groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("begin_at")).alias("n_shared"))
    sized = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    out = sized.join(per, "doc_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("bigint"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)).otherwise(0.0))
