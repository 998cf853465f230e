"""Macro F0.5 of sets of pairs, and checks of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_entity_f05(pred: DataFrame, truth: DataFrame, all_s1: DataFrame) -> DataFrame:
    """``s1, n_pred, n_true, tp, f05``: 1.25 tp / (n_pred + n_true / 4) of every S1; 1 where both are empty."""
    pairs = pred.select("s1", "rid").distinct().withColumn("x", F.lit(1)).join(truth.select("s1", "rid").distinct().withColumn("y", F.lit(1)), ["s1", "rid"], "full")
    per = pairs.groupBy("s1").agg(F.count("x").alias("n_pred"), F.count("y").alias("n_true"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("tp"))
    df = all_s1.select("s1").distinct().join(per, "s1", "left").fillna(0, ["n_pred", "n_true", "tp"])
    score = F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_true")))
    return df.withColumn("f05", score)


def macro_f05(per: DataFrame, weight: str | None = None) -> DataFrame:
    return per.agg((F.avg("f05") if weight is None else F.try_divide(F.sum(F.col("f05") * F.col(weight)), F.sum(weight))).alias("macro_f05"))


def report(per: DataFrame, countries: DataFrame) -> DataFrame:
    """``level, value, n_s1, macro_f05, precision, recall, pred_per_s1`` over all, by country, and by number of true matches (0, 1-3, 4+), in one pass."""
    df = per.join(countries.select("s1", "country"), "s1", "left").withColumn("bucket", F.when(F.col("n_true") == 0, "0").when(F.col("n_true") <= 3, "1-3").otherwise("4+"))
    sets = df.groupingSets([[], ["country"], ["bucket"]], "country", "bucket").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n_s1"), F.avg("f05").alias("macro_f05"), F.try_divide(F.sum("tp").cast("double"), F.sum("n_pred")).alias("precision"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("n_true")).alias("recall"), F.avg("n_pred").alias("pred_per_s1"),
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "country").otherwise("bucket")
    return sets.select(level.alias("level"), F.coalesce("country", "bucket", F.lit("")).alias("value"), "n_s1", *(F.round(c, 6).alias(c) for c in ("macro_f05", "precision", "recall", "pred_per_s1")))


def mixed_f05(per: DataFrame, countries: DataFrame, mix: dict[str, float]) -> DataFrame:
    """Mean of the countries' macro F0.5 weighted by ``mix``; countries outside it are left out, the weights of those present sum to 1."""
    w = F.create_map(*(F.lit(x) for kv in mix.items() for x in kv))
    by = per.join(countries.select("s1", "country"), "s1").groupBy("country").agg(F.avg("f05").alias("f")).withColumn("w", F.try_element_at(w, F.col("country"))).where("w is not null")
    return by.agg(F.try_divide(F.sum(F.col("f") * F.col("w")), F.sum("w")).alias("mixed_f05"))


def check_id_lists(lists: DataFrame, all_s1: DataFrame, known: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """``error, n`` for each rule that ``lists(source1_entity_id, matched_entity_ids)`` breaks.

    duplicate_row, missing_s1, extra_s1; over the ids: duplicate_id, self_match, wrong_prefix and, with ``known(entity_id)``, unknown_id.
    """
    rows = lists.select(F.col("source1_entity_id").alias("s1"), F.coalesce("matched_entity_ids", F.lit("")).alias("ids"))
    ids = rows.select("s1", F.explode(F.split("ids", ",")).alias("rid")).select("s1", F.trim("rid").alias("rid")).where("rid <> ''")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("error"), "n")
    wrong = ~F.lit(False)
    for p in prefixes:
        wrong &= ~F.col("rid").startswith(p)
    out = count(rows.groupBy("s1").count().where("count > 1"), "duplicate_row")
    s1 = all_s1.select("s1").distinct()
    for df, name in (
        (s1.join(rows, "s1", "left_anti"), "missing_s1"), (rows.select("s1").distinct().join(s1, "s1", "left_anti"), "extra_s1"), (ids.groupBy("s1", "rid").count().where("count > 1"), "duplicate_id"),
        (ids.where("s1 = rid"), "self_match"), (ids.where(wrong), "wrong_prefix"),
    ):
        out = out.unionByName(count(df, name))
    if known is not None:
        out = out.unionByName(count(ids.select("rid").distinct().join(known.select(F.col("entity_id").alias("rid")), "rid", "left_anti"), "unknown_id"))
    return out.where("n > 0")


def check_subset(matches: DataFrame, cands: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates: a warning each."""
    return matches.select("s1", "rid").distinct().join(cands.select("s1", "rid"), ["s1", "rid"], "left_anti")


def check_tsv(spark, path: str, header: tuple[str, ...]) -> list[str]:
    """What is wrong with the form of a tab-separated file: missing, wrong header, commas for tabs, malformed rows, encoding."""
    try:
        lines = spark.read.text(path)
        first = lines.first()
    except Exception as e:  # the reader names the cause only in its text
        if "PATH_NOT_FOUND" in str(e):
            return ["missing file"]
        raise
    out = []
    head = first["value"] if first else ""
    if head.split("\t") != list(header):
        out.append("comma instead of tab" if head.split(",") == list(header) else "wrong header")
    bad = lines.agg(F.count_if(F.size(F.split("value", "\t")) != len(header)).alias("rows"), F.count_if(F.col("value").contains("�")).alias("bytes")).first()
    return out + ["malformed row"] * (bad["rows"] > 0) + ["encoding"] * (bad["bytes"] > 0)
