"""Queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlink.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.names import link_names

    return link_names(table(spark, d, "prepared", "gid", "name", "country", "name_key", "split").where("split = 'test'"), nicknames=table(spark, d, "nicknames"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.addresses import link_addresses

    rows = table(spark, d, "prepared", "gid", "addr", "country", "addr_roman", "split").where("split = 'test'")
    return link_addresses(rows, table(spark, d, "places"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("s1", "rid")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.linkage import link_records

    rows = table(spark, d, "records", "row_id", "entity_id", "name", "addr", "country", "src", "split").where("split = 'test'")
    return link_records(rows, table(spark, d, "places"), nicknames=table(spark, d, "nicknames"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top5(spark, d).select("s1", "rid")


def p2_top5(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.topn_runs import scored_candidates, top_n_per_group

    pairs = scored_candidates(table(spark, d, "cands", "s1", "rid"), table(spark, d, "test_scores", "s1", "rid", "p"))
    return top_n_per_group(pairs, "s1", "rid", "p", 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.unicode_forms import unify_fields

    forms = unify_fields(table(spark, d, "records", "row_id", "name", "addr"), "row_id", ["name", "addr"])
    return forms.where("changed").select("row_id", "field")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.unicode_forms import unify_fields

    forms = unify_fields(table(spark, d, "records", "row_id", "name", "addr"), "row_id", ["name", "addr"])
    return forms.select("row_id", "field", "canonical", "changed")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.splits import split_entities

    return split_entities(
        table(spark, d, "cands", "s1"),
        table(spark, d, "prepared", "gid", "entity_id"),
        table(spark, d, "records", "entity_id"),
        table(spark, d, "train_matches", "source1_entity_id", "matched_entity_ids"),
    )


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``cands`` per split, and how they compare with the wanted share."""
    splits = p6_splits(spark, d).where("s1 is not null")
    rows = table(spark, d, "cands", "s1").where("s1 is not null").groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    per = rows.join(splits, "s1").groupBy("split").agg(F.sum("n").alias("n_rows"))
    whole = per.agg(F.sum("n_rows").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).select("split", "n_rows", F.round(F.col("n_rows") / F.col("whole"), 4).alias("share"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.packing import pack_texts

    return pack_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_matches(spark, d).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.leakage import find_leaks

    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that hold no passage of an evaluation item."""
    from loomlink.llm.leakage import without_leaks

    return without_leaks(table(spark, d, "documents", "doc_id"), p8_matches(spark, d)).select("doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.spans import shared_spans

    return shared_spans(table(spark, d, "documents", "doc_id", "text"))


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    from loomlink.llm.spans import shared_share

    return shared_share(table(spark, d, "documents", "doc_id", "text"), p9_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p3_found, p4_found, p4_matches, p2_found, p2_top5, p5_found, p5_forms, p6_splits, p6_shares, p7_containers, p8_found, p8_matches, p8_clean, p9_found, p9_share)
}

_BEST = """
with s as (select s1, rid, max(p) as p from test_scores where not isnan(p) and p between 0 and 1 group by s1, rid),
  c as (select distinct s1, rid from cands where s1 is not null and rid is not null),
  r as (select s1, rid, s.p::double as p, row_number() over (partition by s1 order by s.p desc, rid)::int as place from c join s using (s1, rid))
"""

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')"
_LEAKS = (
    f"with i as (select item_id, {_WORDS.format('text')} as w from eval_items where item_id is not null and text is not null), d as (select doc_id, {_WORDS.format('text')} as w from documents where doc_id is not null and text is not null), "
    "ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from i where len(w) >= 13), "
    "dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from d where len(w) >= 13), "
    "f as (select distinct doc_id, item_id from dg join ig using (g)) "
)
_SPANS = """
with t as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 100),
  w as (select doc_id, k, substr(text, k + 1, 100) as s from (select doc_id, text, unnest(range(0, length(text) - 99)) as k from t)),
  m as (select s from w group by s having count(distinct doc_id) > 1),
  h as (select distinct doc_id, k from w semi join m using (s)),
  g as (select *, case when k <= lag(k) over (partition by doc_id order by k) + 100 then 0 else 1 end as fresh from h),
  r as (select *, sum(fresh) over (partition by doc_id order by k) as run from g)
select doc_id, min(k)::bigint as begin_at, (max(k) + 100)::bigint as end_at from r group by doc_id, run
"""


def _odd_sql(field: str) -> str:
    """Rows whose ``field`` needs another form, by what its characters are and what stands beside them."""
    invisible = "\\x{AD}\\x{34F}\\x{61C}\\x{180E}\\x{200B}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{FE00}-\\x{FE0F}"
    blank = "\\t\\n\\r\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
    forms = "\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{FB00}-\\x{FB06}\\x{2160}-\\x{217F}\\x{1D400}-\\x{1D7FF}"
    latin, indic, joiner = "A-Za-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}", "\\x{900}-\\x{DFF}", "\\x{200C}\\x{200D}"
    foreign = f"[^\\P{{L}}{latin}\\x{{AA}}\\x{{BA}}{forms}{indic}]"
    either = f"[{invisible}{blank}{forms}]|[{latin}][\\x{{300}}-\\x{{36F}}]|[{latin}]{foreign}|{foreign}[{latin}]|(^|[^{indic}{joiner}])[{joiner}]|[{joiner}]($|[^{indic}{joiner}])"
    return f"select row_id, '{field}' as field from records where regexp_matches({field}, '{either}')"


SQL: dict[str, str] = {
    "p2_found": _BEST + "select s1, rid from r where place <= 5",
    "p2_top5": _BEST + "select s1, rid, p, place from r where place <= 5",
    "p5_found": _odd_sql("name") + " union all " + _odd_sql("addr"),
    "p8_found": _LEAKS + "select doc_id, item_id from f",
    "p8_clean": _LEAKS + "select doc_id from documents where doc_id not in (select doc_id from f)",
    "p9_found": _SPANS,
    "p9_share": f"with sp as ({_SPANS}), z as (select doc_id, max(coalesce(length(text), 0))::bigint as n_chars from documents group by doc_id), y as (select doc_id, sum(end_at - begin_at)::bigint as s from sp group by doc_id) "
    "select doc_id, n_chars, coalesce(s, 0)::bigint as n_shared, case when n_chars > 0 then round(coalesce(s, 0) / n_chars, 6) else 0.0 end as share from z left join y using (doc_id)",
}
