"""Candidate pairs: weighted n-gram postings, top-k similarity join, exact buckets, recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loomlink.operators import topk
from loomlink.operators.jvm import map_partitions
from loomlink.session import cut

RETRIEVERS = ("addr_fwd", "comb_fwd", "blank_fwd", "comb_rev")


def char_grams(text: Column, n: int = 3, in_words: bool = False) -> Column:
    """All n-grams of a text; ``in_words`` pads every word with blanks and stays inside it."""

    def grams(t: Column) -> Column:
        return F.when(F.char_length(t) >= n, F.transform(F.sequence(F.lit(1), F.char_length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    if not in_words:
        return grams(text)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit(" "), w, F.lit(" ")))))


def postings(df: DataFrame, key: str, text: str, within: str, n: int = 3, in_words: bool = False, min_df: int = 2, max_df: float = 0.5) -> DataFrame:
    """``within, gram, key, w``: weights (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each text's vector of length 1.

    N and df count the texts of a ``within`` value; grams in fewer than ``min_df`` of them, or in more than the share
    ``max_df``, are left out. Texts without a gram have no postings.
    """
    rows = df.select(within, key, text).where(F.col(text) != "")
    tf = rows.select(within, key, F.explode(char_grams(F.col(text), n, in_words)).alias("gram")).groupBy(within, key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    docs = rows.groupBy(within).agg(F.count(F.lit(1)).alias("docs"))
    df_ = tf.groupBy(within, "gram").agg(F.count(F.lit(1)).alias("df")).join(docs, within)
    idf = df_.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs"))).select(within, "gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, [within, "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(within, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [within, key]).select(within, "gram", key, (F.col("w") / F.col("norm")).alias("w"))


def topk_join(queries: DataFrame, index: DataFrame, k: int, within: str, q: str = "q", i: str = "i", digits: int = 6) -> DataFrame:
    """``within, q, i, score, rank``: the ``k`` rows of ``index`` most like each query by the dot product of their postings.

    Scores are rounded to ``digits``, ties go to the smaller ``i``; only positive scores come out. The rank limit is
    applied before and after the exchange, so no task sorts all partners of a query.
    """
    a = queries.select(within, "gram", F.col(q).alias("q"), F.col("w").alias("wq"))
    b = index.select(within, "gram", F.col(i).alias("i"), F.col("w").alias("wi"))
    scored = a.join(b, [within, "gram"]).groupBy(within, "q", "i").agg(F.round(F.sum(F.col("wq") * F.col("wi")), digits).alias("score")).where("score > 0")
    order = Window.partitionBy(within, "q").orderBy(F.desc("score"), "i")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def combined_postings(name: DataFrame, addr: DataFrame) -> DataFrame:
    """Postings of two fields as one vector: the dot product is the mean of both cosines."""
    half = F.sqrt(F.lit(0.5))
    tag = lambda df, t: df.withColumn("gram", F.concat(F.lit(t), "gram")).withColumn("w", F.col("w") * half)
    return tag(name, "n:").unionByName(tag(addr, "a:"))


def by_key(records: DataFrame, within: str, key: str, fields: list[str], *sides: Column) -> DataFrame:
    """``within, key, sides, fields, n_fields``: one row for each key and side, with the texts of its rows in one and how many of them are not empty. NULL keys match nothing. Stored, as it is read many times."""
    rows = records.where(F.col(within).isNotNull() & F.col(key).isNotNull())
    texts = [F.array_join(F.collect_list(F.when(F.col(f) != "", F.col(f))), topk.SEP).alias(f) for f in fields]
    return cut(rows.groupBy(within, key, *sides).agg(*texts, *(F.count_if(F.col(f) != "").alias(f"n_{f}") for f in fields)))


def gram_weights(rows: DataFrame, within: str, fields: dict[str, bool], min_df: int = 2, max_df: float = 0.5) -> DataFrame:
    """``within, part, code, idf`` of the 3-grams of ``fields`` (True: inside words) in the rows of ``by_key``, as ``postings`` weighs them; a part is a field's number."""

    def counted(batches):
        for df in batches:
            for w, group in df.groupby(within, sort=False):
                for part, (f, inside) in enumerate(fields.items()):
                    row, code = topk.gram_codes(group[f].tolist(), inside)
                    codes, at = np.unique(code, return_inverse=True)
                    own = np.bincount(np.unique(row * len(codes) + at) % max(len(codes), 1), minlength=len(codes))
                    yield pd.DataFrame({within: w, "part": np.int32(part), "code": codes, "df": own})

    kind = rows.schema[within].dataType.simpleString()
    df_ = rows.select(within, *fields).mapInPandas(counted, f"`{within}` {kind}, part int, code bigint, df bigint").groupBy(within, "part", "code").agg(F.sum("df").alias("df"))
    docs = rows.groupBy(within).agg(F.array(*(F.sum(f"n_{f}") for f in fields)).alias("docs")).select(within, F.posexplode("docs").alias("part", "docs"))
    return df_.join(docs, [within, "part"]).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs"))).select(within, "part", "code", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


# How many queries a task takes at least and at most, copies of the index that are made in between, rows of the index in one task, and of those in one search.
QUERIES_AT_ONCE, MOST_QUERIES_AT_ONCE, COPIES, INDEX_AT_ONCE, ROWS_AT_ONCE = 8192, 1 << 16, 12, 1 << 18, 1 << 15
# fixed values end


def topk_texts(queries: DataFrame, index: DataFrame, weights: DataFrame, k: int, within: str, key: str, fields: dict[str, bool], digits: int = 6) -> DataFrame:
    """What ``topk_join`` gives for the vectors of ``fields`` (their mean, if several), from rows of ``by_key`` and their ``gram_weights``.

    Pairs are never rows: texts travel, each part of the queries meets each part of the index in one task, and only the best ``k`` come out.
    """
    names = list(fields)
    kinds = {c: queries.schema[c].dataType.simpleString() for c in (within, key)}
    some = lambda df: df.where(F.greatest(*(F.char_length(f) for f in [*names, names[0]])) > 2 - any(fields.values()))
    queries, index = some(queries), some(index)
    rows = F.count(F.lit(1))
    count = lambda df, n, size: df.groupBy(within).agg(F.ceil(rows / size).cast("int").alias(n))
    asked = F.greatest(F.lit(QUERIES_AT_ONCE), F.least(F.lit(MOST_QUERIES_AT_ONCE), F.ceil(rows / COPIES)))
    parts = count(queries, "qs", asked).join(count(index, "is", F.lit(INDEX_AT_ONCE)), within).collect()  # a row for each value of within
    groups = sum(r["qs"] * r["is"] for r in parts)
    if not groups:
        return queries.sparkSession.createDataFrame([], f"`{within}` {kinds[within]}, q {kinds[key]}, i {kinds[key]}, score double, rank int")
    sizes = F.broadcast(queries.sparkSession.createDataFrame([(r[within], r["qs"], r["is"]) for r in parts], f"`{within}` {kinds[within]}, qs int, `is` int"))
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    text = [F.col(f) for f in names]
    none = [F.lit(None).cast("string").alias(f) for f in names]
    no_idf = [F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("double").alias("idf")]
    q = queries.join(sizes, within).select(within, own("qs").alias("qp"), each("is").alias("ip"), F.lit(1).alias("kind"), F.col(key).alias("key"), *no_idf, *text)
    i = index.join(sizes, within).select(within, each("qs").alias("qp"), own("is").alias("ip"), F.lit(2).alias("kind"), F.col(key).alias("key"), *no_idf, *text)
    w = weights.join(sizes, within).select(within, each("qs").alias("qp"), "is", "part", "code", "idf")
    w = w.select(within, "qp", each("is").alias("ip"), F.lit(0).alias("kind"), F.lit(None).cast(kinds[key]).alias("key"), "part", "code", "idf", *none)
    met = q.unionByName(i).unionByName(w).repartition(groups, within, "qp", "ip").sortWithinPartitions(within, "qp", "ip", "kind", "key")
    found = StructType([StructField(within, queries.schema[within].dataType), *(StructField(c, queries.schema[key].dataType) for c in "qi"), StructField("score", DoubleType()), StructField("rank", IntegerType())])
    out = map_partitions(met, found, "TopTexts", k, digits, ROWS_AT_ONCE, "".join("w" if x else "-" for x in fields.values()))
    if all(r["is"] == 1 for r in parts):
        return out
    order = Window.partitionBy(within, "q").orderBy(F.desc("score"), "i")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(records: DataFrame, k: dict[str, int] | None = None) -> DataFrame:
    """``s1, rid, retriever, score, rank`` by the retrievers of ``k`` over ``records(gid, src, country, name_key, addr_roman)``, within countries."""
    k = k or {"addr_fwd": 50, "comb_fwd": 50, "blank_fwd": 30, "comb_rev": 3}
    name, addr = {"name_key": False}, {"addr_roman": True}
    rows = by_key(records, "country", "gid", ["name_key", "addr_roman"], (F.col("src") == 1).alias("listed"), (F.col("addr_roman") == "").alias("blank"))
    all_weights, out = cut(gram_weights(rows, "country", name | addr)), None
    for r, n in k.items():
        fields = {"addr": addr, "comb": name | addr, "name": name, "blank": name}[r.split("_")[0]]
        weights = all_weights if fields == name | addr else all_weights.where(F.col("part") == int(fields == addr)).withColumn("part", F.lit(0))
        listed, others = rows.where("listed"), rows.where("not listed and blank" if r.startswith("blank") else "not listed")
        if r.endswith("_fwd"):
            hits = topk_texts(listed, others, weights, n, "country", "gid", fields).select(F.col("q").alias("s1"), F.col("i").alias("rid"), "score", "rank")
        else:
            hits = topk_texts(others, listed, weights, n, "country", "gid", fields).select(F.col("i").alias("s1"), F.col("q").alias("rid"), "score", "rank")
        part = hits.select("s1", "rid", F.lit(r).alias("retriever"), "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def unique_key_link(records: DataFrame) -> DataFrame:
    """``s1, rid``: records whose key belongs to exactly one listed entity of their country; empty keys link to nothing."""
    listed = records.where("src = 1 and name_key <> ''").groupBy("country", "name_key").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("s1")).where("n = 1")
    others = records.where("src <> 1 and name_key <> ''").select("country", "name_key", F.col("gid").alias("rid"))
    return others.join(listed, ["country", "name_key"]).select("s1", "rid")


def exact_pairs(records: DataFrame, heavy: int = 20) -> DataFrame:
    """``s1, rid`` with the same key, or the same key and first number; keys of more than ``heavy`` listed entities need the number too."""
    rows = records.where("name_key <> ''").select("country", "name_key", "gid", "src", F.get(F.split("addr_nums", " "), F.lit(0)).alias("first"))
    keys = rows.where("src = 1").groupBy("country", "name_key").agg(F.count(F.lit(1)).alias("n"))
    listed = rows.where("src = 1").select("country", "name_key", F.col("gid").alias("s1"), "first")
    others = rows.where("src <> 1").select("country", "name_key", F.col("gid").alias("rid"), "first")
    light = listed.join(keys.where(F.col("n") <= heavy), ["country", "name_key"]).join(others.drop("first"), ["country", "name_key"]).select("s1", "rid")
    numbered = listed.where("first <> ''").join(others, ["country", "name_key", "first"]).select("s1", "rid")
    return light.union(numbered).distinct()


def union_wide(cands: DataFrame, retrievers: tuple[str, ...] = RETRIEVERS) -> DataFrame:
    """One row per pair: best rank and score of every retriever (NULL where it missed), and how many found it. Upper and lower case of a retriever are one; NULL keys are left out."""
    rows = cands.where("s1 is not null and rid is not null").withColumn("r", F.lower("retriever"))
    cols = []
    for r in retrievers:
        cols += [F.min(F.when(F.col("r") == r, F.col("rank"))).alias(f"blk_{r}_rank"), F.max(F.when(F.col("r") == r, F.col("score"))).alias(f"blk_{r}_score")]
    wide = rows.groupBy("s1", "rid").agg(*cols)
    hits = sum((F.col(f"blk_{r}_rank").isNotNull().cast("int") for r in retrievers[1:]), F.col(f"blk_{retrievers[0]}_rank").isNotNull().cast("int"))
    return wide.withColumn("blk_n_hits", hits)


def with_competition(wide: DataFrame, retrievers: tuple[str, ...] = RETRIEVERS) -> DataFrame:
    """``s1_n_cands, s1_rank_best, s1_gap_best``: where a pair's best score stands among its S1's candidates."""
    best = F.greatest(*(F.col(f"blk_{r}_score") for r in retrievers))
    df = wide.withColumn("best", F.coalesce(best, F.lit(0.0)))
    per = df.groupBy("s1").agg(F.count(F.lit(1)).alias("s1_n_cands"), F.max("best").alias("top"))
    rank = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("best"), "rid"))
    return df.withColumn("s1_rank_best", rank).join(per, "s1").select(*wide.columns, "s1_n_cands", "s1_rank_best", (F.col("best") - F.col("top")).alias("s1_gap_best"))


def recall_report(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """``retriever, n_cands, n_true, recall, alone``: found true pairs of each retriever and of all; ``alone`` counts those no other found."""
    rows = cands.where("s1 is not null and rid is not null").select("s1", "rid", F.lower("retriever").alias("retriever")).distinct()
    hit = rows.join(truth.select("s1", "rid", F.lit(1).alias("hit")), ["s1", "rid"], "left")
    finders = rows.groupBy("s1", "rid").agg(F.count(F.lit(1)).alias("finders"))
    per = hit.join(finders, ["s1", "rid"]).groupBy("retriever").agg(F.count(F.lit(1)).alias("n_cands"), F.count("hit").alias("n_true"), F.count_if((F.col("finders") == 1) & F.col("hit").isNotNull()).alias("alone"))
    whole = hit.select("s1", "rid", "hit").distinct().agg(F.lit("all").alias("retriever"), F.count(F.lit(1)).alias("n_cands"), F.count("hit").alias("n_true"), F.lit(0).cast("bigint").alias("alone"))
    total = truth.agg(F.count(F.lit(1)).alias("total"))  # one row
    return per.unionByName(whole).crossJoin(F.broadcast(total)).select("retriever", "n_cands", "n_true", F.round(F.try_divide(F.col("n_true").cast("double"), "total"), 6).alias("recall"), "alone")


def missed(truth: DataFrame, cands: DataFrame) -> DataFrame:
    return truth.join(cands.select("s1", "rid"), ["s1", "rid"], "left_anti")


# From which likeness names and addresses count as similar, and as changed, and what the cases are called.
SIMILAR_NAME, CHANGED_NAME, SIMILAR_ADDRESS = 80, 50, 60
MISSES = ("blank addr, name similar", "blank addr, name changed", "both similar (crowded out)", "renamed, addr similar", "name similar, addr damaged", "both damaged")
# fixed values end


def diagnose(miss: DataFrame, records: DataFrame) -> DataFrame:
    """``miss`` with ``ns, as, cat``: why a true pair was not found, from the likeness of names and addresses."""
    from loomlink.functions.similarity import token_set_ratio

    side = lambda key, n: records.select(F.col("gid").alias(key), F.col("name_roman").alias("n" + n), F.col("addr_roman").alias("a" + n))
    df = miss.join(side("s1", "1"), "s1").join(side("rid", "2"), "rid").withColumn("ns", token_set_ratio(F.col("n1"), F.col("n2"))).withColumn("as", token_set_ratio(F.col("a1"), F.col("a2")))
    blank, near, there = F.col("a2") == "", F.col("ns") >= SIMILAR_NAME, F.col("as") >= SIMILAR_ADDRESS
    tests = (blank & near, blank, near & there, (F.col("ns") < CHANGED_NAME) & there, near)
    cat = F.coalesce(*(F.when(t, name) for t, name in zip(tests, MISSES)), F.lit(MISSES[-1]))
    return df.withColumn("cat", cat).drop("n1", "a1", "n2", "a2")
