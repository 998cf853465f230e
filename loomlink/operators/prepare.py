"""Prepared records: normalised, romanised, with keys and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.functions import text as tx
from loomlink.operators.translit import add_roman, aligned_words, learn_table

COLUMNS = ["gid", "entity_id", "name", "addr", "country", "src", "name_roman", "addr_roman", "name_key", "addr_nums", "n_indic_unknown"]


def with_gid(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """``records`` with ``gid``, a bigint that depends on nothing but the record's id."""
    return records.withColumn("gid", F.xxhash64(key))


def romanisation(records: DataFrame, truth: DataFrame) -> DataFrame:
    """The table of romanisations learned from matched pairs ``truth(s1, rid)`` of entity ids."""
    names = tx.add_norm(records).select("entity_id", "name_norm")
    left, right = names.select(F.col("entity_id").alias("s1"), F.col("name_norm").alias("l")), names.select(F.col("entity_id").alias("rid"), F.col("name_norm").alias("r"))
    return learn_table(aligned_words(truth.join(left, "s1").join(right, "rid"), "l", "r"))


def prepared(records: DataFrame, table: DataFrame) -> DataFrame:
    """``COLUMNS`` of ``records(entity_id, name, addr, country, src)``, romanised by ``table(ind, lat)``.

    ``name_key`` is the romanised name without legal forms and blanks, or with them if nothing else is left;
    ``n_indic_unknown`` counts the words of the name that the table lacks. One row for each different ``entity_id``,
    the delivery whose fields come first; NULL ids are left out, NULL texts are empty.
    """
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "addr", "country")}
    rows = records.where("entity_id is not null").select("entity_id", *(c.alias(n) for n, c in texts.items()), "src")
    rows = rows.groupBy("entity_id").agg(F.min(F.struct("name", "addr", "country", "src")).alias("r")).select("entity_id", "r.*")
    df = add_roman(tx.add_norm(with_gid(rows)), table, {"name_norm": "name_roman", "addr_norm": "addr_roman"}, "gid")
    bare = F.replace(tx.without_words(F.col("name_roman"), tx.LEGAL_FORMS), F.lit(" "), F.lit(""))
    key = F.when(bare == "", F.replace("name_roman", F.lit(" "), F.lit(""))).otherwise(bare)
    return df.withColumn("name_key", key).withColumn("n_indic_unknown", tx.indic_words(F.col("name_roman")).cast("tinyint")).select(*COLUMNS)
