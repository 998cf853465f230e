"""Filling containers of fixed capacity by the sum-of-squares rule.

Items are sizes in tokens. A hash spreads the items evenly over shards of a bounded number of items; each
shard packs its own containers. An item goes where, afterwards, the sum over all residual gaps of the
squared number of open containers with that gap is smallest. A second pass empties the containers that
stayed less full than wanted and packs their items again, in far fewer shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


_MOST_TOKENIZER_BYTES = 64 << 20


@cache
def _encoding_of(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def tokenizer_files(path: str, pattern: str | None = None) -> tuple[bytes, str]:
    """The rank file and the pattern that splits text, which the module beside the file names unless it is given."""
    if pattern is None:
        import importlib.util
        import os

        spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(os.path.dirname(path), "__init__.py"))
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        pattern = files.PATTERN
    with open(path, "rb") as f:
        return f.read(), pattern


def encoding(path: str, pattern: str | None = None):
    """The tiktoken encoding of a rank file."""
    return _encoding_of(*tokenizer_files(path, pattern))


def token_counts(df: DataFrame, text: str, path: str = TOKENIZER, out: str = "n_tokens", pattern: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of ``text``; NULL and empty text have 0.

    The tokenizer's file is read by the driver only and broadcast, once its size is found to be within bounds.
    """
    files = tokenizer_files(path, pattern)
    if len(files[0]) > _MOST_TOKENIZER_BYTES:
        raise ValueError(f"{path} is too large for every task to hold")
    shared = df.sparkSession.sparkContext.broadcast(files)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding_of(*shared.value)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return df.withColumn(out, count(F.col(text)))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, in the given order, and what each container holds at the end.

    Placing an item of size s into a container with gap g takes one from count[g] and adds one to
    count[g - s]; full containers and unopened ones (gap 0 and ``capacity``) don't count. Of equally good
    gaps the smallest is taken, of containers with that gap the last used. Items of size 0 join container 0.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, fill = np.zeros(len(sizes), np.int64), []
    gaps = np.arange(capacity + 1)
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        # The change of the sum: (c[g-s]+1)^2 - c[g-s]^2 + (c[g]-1)^2 - c[g]^2 = 2 (c[g-s] - c[g] + 1).
        cost = 2 * (count[: capacity + 1 - s] - count[s:] + 1)
        cost[0] = 1 - 2 * count[s]
        usable = count[s:] > 0
        usable[-1] = False
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best, gap = fresh, -1
        if usable.any():
            options = np.where(usable, cost, np.iinfo(np.int64).max)
            k = int(options.argmin())
            if options[k] <= fresh:
                best, gap = options[k], k + s
        if gap < 0:
            b, left = len(fill), capacity - s
            fill.append(s)
        else:
            b, left = open_at[gap].pop(), gap - s
            count[gap] -= 1
            fill[b] += s
        place[i] = b
        if left:
            open_at[left].append(b)
            count[left] += 1
    if len(sizes) and not fill:
        fill.append(0)
    return place, np.array(fill, np.int64)


def _pack_shards(capacity: int, level: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [df for df in batches if not df.empty]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        del held
        for shard, part in rows.groupby("shard", sort=True):
            # The rule is made for items in no particular order; sorted ones pack worse.
            part = part.sort_values(["h", "id", "piece"])
            place, fill = sum_of_squares(part["size"].to_numpy(), capacity)
            yield pd.DataFrame(
                {"id": part["id"], "piece": part["piece"], "size": part["size"], "container": (level << 58) + (int(shard) << 28) + place, "fill": fill[place]}
            )

    return pack


_PACKED = "id bigint, piece int, size int, container bigint, fill int"


def pack_items(items: DataFrame, capacity: int, shards: int, full: float = 0.97, regroup: int = 64) -> DataFrame:
    """``id, piece, size, container, fill`` of every row of ``items(id, piece, size)``.

    Sizes are from 0 to ``capacity``. Each shard packs on its own; the containers under ``full`` of the
    capacity are emptied and their items packed again in one ``regroup``-th of the shards. A shard should
    hold a bounded number of items: choose ``shards`` in proportion to the rows.
    """
    def spread(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("h", F.xxhash64("id", "piece", F.lit(k))).withColumn("shard", F.pmod("h", F.lit(k)).cast("int"))

    first = spread(items, shards).repartition(shards, "shard").mapInPandas(_pack_shards(capacity, 0), _PACKED)
    if shards == 1:
        return first
    from loomlink.session import cut

    first = cut(first)
    again = max(1, shards // regroup)
    rest = first.where(F.col("fill") < full * capacity).select("id", "piece", "size")
    second = spread(rest, again).repartition(again, "shard").mapInPandas(_pack_shards(capacity, 1), _PACKED)
    return first.where(F.col("fill") >= full * capacity).unionByName(second)


def pack_texts(docs: DataFrame, key: str, text: str, capacity: int = 512, items_per_shard: int = 20_000, path: str = TOKENIZER) -> DataFrame:
    """``key, piece, begin_token, n_tokens, container, used`` of every text, measured in tokens.

    A text is split only if it alone exceeds the capacity, then into pieces of exactly the capacity and a
    rest. NULL and empty texts have no tokens and lie in some container of their shard, or an empty one.
    ``key`` is a bigint; rows with a repeated key are packed one by one, rows with a NULL key are left out.
    """
    sized = token_counts(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null"), "t", path)
    pieces = sized.select(
        "id",
        F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("int"))).alias("piece", "x"),
        "n_tokens",
    ).select("id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))
    from loomlink.session import cut

    pieces = cut(pieces)
    shards = max(1, -(-pieces.count() // items_per_shard))
    packed = pack_items(pieces, capacity, shards)
    return packed.select(F.col("id").alias(key), "piece", (F.col("piece") * capacity).cast("int").alias("begin_token"), F.col("size").alias("n_tokens"), "container", F.col("fill").alias("used"))
