"""Evaluation texts inside training text, through suffix arrays over the words of the training shards.

Every task takes a share of the documents and builds the suffix array of its words in blocks of bounded
size, once; all suffixes of the evaluation items are binary-searched in it, block of items by block of items. The
blocks come by broadcast, each of a checked size, and a pass over the documents takes so many of them as
``_PASS_BYTES`` allow: one pass for some hundred million words of items, more only beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 13
_WORDS_PER_BLOCK = 2_000_000
_QUERY_BYTES = 16 << 20
_PASS_BYTES = 512 << 20
_SPOTS_AT_ONCE = 2_000_000


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, combining marks and digits of the lower-cased text."""
    import regex

    global _WORD
    try:
        pattern = _WORD
    except NameError:
        pattern = _WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
    return pattern.findall(text.lower())


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, a 0 after each text, and the number of words of each text."""
    import xxhash

    digest, codes, lengths, known = xxhash.xxh64_intdigest, [], [], {}
    for t in texts:
        ws = words_of(t) if t else []
        for w in ws:
            c = known.get(w)
            if c is None:
                if len(known) > 500_000:
                    known.clear()
                c = known[w] = (digest(w.encode()) >> 1) | 1
            codes.append(c)
        codes.append(0)
        lengths.append(len(ws))
    return np.array(codes, np.int64), np.array(lengths, np.int64)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the next ``depth`` (or more) codes; what lies beyond the end counts as 0."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:]
        key = rank * (rank.max() + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1:
            break
    return order


def _bound(codes: np.ndarray, order: np.ndarray, queries: np.ndarray, right: bool) -> np.ndarray:
    """Per row of ``queries`` (same width), the first place of ``order`` whose suffix is not below it (above it, if ``right``)."""
    n, width = len(order), queries.shape[1]
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
    padded = np.concatenate([codes, np.zeros(width, np.int64)])
    for _ in range(int(n).bit_length() + 1):
        active = np.flatnonzero(lo < hi)
        if not len(active):
            break
        mid = (lo[active] + hi[active]) >> 1
        at, state = order[mid], np.zeros(len(active), np.int8)
        for k in range(width):
            have, want = padded[at + k], queries[active, k]
            state = np.where(state != 0, state, np.sign(np.where(have < want, -1, np.where(have > want, 1, 0))).astype(np.int8))
        below = state < 0 if not right else state <= 0
        lo[active[below]] = mid[below] + 1
        hi[active[~below]] = mid[~below]
    return lo


def leaked_in_block(ids: np.ndarray, texts: list[str], blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> Iterator[pd.DataFrame]:
    """``doc_id, item_id, n_words, doc_word, item_word``: per pair the longest verbatim match of ``width`` words or more.

    A frame for each of the ``blocks`` of items ``(ids, codes, lengths)``; the suffix array is built once.
    """
    codes, lengths = word_codes(texts)
    if len(codes) <= width:
        return
    order, present, doc_starts = None, np.unique(codes), np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    for item_ids, item_codes, item_lengths in blocks:
        starts = np.concatenate([[0], np.cumsum(item_lengths + 1)[:-1]])
        spots = [np.arange(s, s + k - width + 1) for s, k in zip(starts, item_lengths) if k >= width]
        if not spots:
            continue
        spots = np.concatenate(spots)
        # Only suffixes whose first word occurs in the block can be there at all.
        spots = spots[np.isin(item_codes[spots], present)]
        if not len(spots):
            continue
        if order is None:
            order = suffix_array(codes, width)
        queries = item_codes[spots[:, None] + np.arange(width)]
        lo, hi = _bound(codes, order, queries, False), _bound(codes, order, queries, True)
        met = hi > lo
        for d, q in _left_ends(codes, order, item_codes, spots[met], lo[met], hi[met]):
            size = _follow(codes, item_codes, d, q, width)
            dn, qn = np.searchsorted(doc_starts, d, "right") - 1, np.searchsorted(starts, q, "right") - 1
            out = pd.DataFrame({"doc_id": ids[dn], "item_id": item_ids[qn], "n_words": size, "doc_word": d - doc_starts[dn], "item_word": q - starts[qn]})
            yield out.sort_values(["doc_id", "item_id", "n_words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc_id", "item_id"])


def _left_ends(codes: np.ndarray, order: np.ndarray, item_codes: np.ndarray, spots: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the documents and in the items where a match begins, a bounded number at a time, however common a passage is."""
    k, done = 0, 0
    while k < len(spots):
        ends = np.cumsum(hi[k:] - lo[k:]) - done
        most = max(1, int(np.searchsorted(ends, _SPOTS_AT_ONCE, "right")))
        a, b = lo[k : k + most].copy(), hi[k : k + most].copy()
        a[0] += done
        if b[0] - a[0] > _SPOTS_AT_ONCE:
            b[0] = a[0] + _SPOTS_AT_ONCE
            done += _SPOTS_AT_ONCE
        else:
            k, done = k + most, 0
        counts = b - a
        q = np.repeat(spots[k - most : k] if not done else spots[k : k + 1], counts)
        d = order[np.repeat(a, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        # Only the left end of a match is kept; from there it is followed to its right end.
        before_d, before_q = np.where(d > 0, codes[d - 1], 0), np.where(q > 0, item_codes[q - 1], 0)
        left = (before_d != before_q) | (before_d == 0)
        if left.any():
            yield d[left], q[left]


def _follow(codes: np.ndarray, item_codes: np.ndarray, d: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """Number of words from ``d`` and ``q`` on that agree, known to be ``width`` at least."""
    size, live = np.full(len(d), width), np.arange(len(d))
    codes_end, item_end = np.append(codes, 0), np.append(item_codes, 0)
    while len(live):
        a, b = codes_end[d[live] + size[live]], item_end[q[live] + size[live]]
        live = live[(a == b) & (a != 0)]
        size[live] += 1
    return size


def _search(shared: list, width: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [tuple(np.frombuffer(x, np.int64) for x in s.value) for s in shared]

        def blocks():
            ids, texts, size = [], [], 0
            for df in batches:
                for i, t in zip(df["doc_id"], df["text"]):
                    ids.append(i)
                    texts.append(t)
                    size += len(t) // 4
                    if size > _WORDS_PER_BLOCK:
                        yield ids, texts
                        ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        for ids, texts in blocks():
            yield from leaked_in_block(np.array(ids, np.int64), texts, items, width)

    return search


def _item_passes(items: DataFrame) -> Iterator[list]:
    """Broadcasts of the items as arrays, each of at most ``_QUERY_BYTES`` of text (one item alone may be larger), in lists of at most ``_PASS_BYTES``."""
    context = items.sparkSession.sparkContext

    def block(ids: list[int], texts: list[str]):
        codes, lengths = word_codes(texts)
        return context.broadcast((np.array(ids, np.int64).tobytes(), codes.tobytes(), lengths.tobytes()))

    ids, texts, size, held, whole = [], [], 0, [], 0
    for row in items.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size * 4 > _QUERY_BYTES:
            held.append(block(ids, texts))
            whole += size * 4
            ids, texts, size = [], [], 0
            if whole >= _PASS_BYTES:
                yield held
                held, whole = [], 0
    if ids:
        held.append(block(ids, texts))
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, n_words, doc_word, item_word``: one row per document and item that share ``min_words`` consecutive words.

    The row holds the longest match; positions count words from 0. Read are ``docs(doc_id, text)`` and
    ``items(item_id, text)``; NULL and empty texts and NULL ids match nothing, repeated ids count as one.
    """
    schema = "doc_id bigint, item_id bigint, n_words bigint, doc_word bigint, item_word bigint"
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for shared in _item_passes(items.where("item_id is not null and length(text) > 0").select(F.col("item_id").cast("bigint").alias("item_id"), "text")):
        part = texts.mapInPandas(_search(shared, min_words), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``docs`` without the documents in ``leaks``; rows without an id stay."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
