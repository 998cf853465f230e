"""Queries over the test tables, one or more for each group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlink.functions import similarity as sim
from loomlink.functions import text as tx
from loomlink.operators import blocking, decide, features, metric, models, prepare, sampling, translit
from loomlink.plans import linkage
from loomlink.sources import files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as bigint, so that engines compare."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c).cast("double"), digits) if kinds[c] in ("double", "float") else F.col(c).cast("bigint") if kinds[c] in ("int", "smallint", "tinyint", "bigint") else F.col(c)).alias(c) for c in df.columns))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """``s1, rid, country, p``: the best valid score of every scored pair."""
    t = table(spark, d, "test_scores", "s1", "rid", "country", "p").where("s1 is not null and rid is not null and p is not null and not isnan(p) and p between 0 and 1")
    return t.groupBy("s1", "rid").agg(F.min("country").alias("country"), F.max("p").cast("double").alias("p"))


SCORES = "sc as (select s1, rid, min(country) as country, max(p)::double as p from test_scores where s1 is not null and rid is not null and not isnan(p) and p between 0 and 1 group by s1, rid)"
LISTED = "l as (select country, name_key, min(gid) as s1 from prepared where src = 1 and name_key <> '' group by country, name_key having count(*) = 1)"
EXACT = f"{LISTED}, ex as (select s1, gid as rid from prepared join l using (country, name_key) where src <> 1)"
TRUTH = "tr as (select distinct s1, trim(r) as rid from (select source1_entity_id as s1, unnest(string_split(matched_entity_ids, ',')) as r from train_matches) where s1 is not null and trim(r) <> '')"
TRUTH_GID = TRUTH + ", tg as (select a.gid as s1, b.gid as rid from tr join prepared a on a.entity_id = tr.s1 join prepared b on b.entity_id = tr.rid)"
WIDE = (
    "w as (select s1, rid, "
    + ", ".join(f"min(case when lower(retriever) = '{r}' then rank end)::bigint as blk_{r}_rank, max(case when lower(retriever) = '{r}' then score end)::double as blk_{r}_score" for r in blocking.RETRIEVERS)
    + " from cands where s1 is not null and rid is not null group by s1, rid)"
)
HITS = " + ".join(f"(blk_{r}_rank is not null)::bigint" for r in blocking.RETRIEVERS)


def words_sql(column: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"list_transform(string_split({column}, ' '), lambda x: case x {cases} else x end)"


# Sources and sinks


@query("select entity_id, coalesce(name, '') as name, coalesce(addr, '') as addr, coalesce(country, '') as country, src::bigint as src from records")
def records_union(spark, d):
    raw = table(spark, d, "records", "entity_id", "name", "addr", "country", "src")
    lists = [raw.where(F.col("src") == i).select("entity_id", F.col("name").alias("business_name"), F.col("addr").alias("business_address"), "country") for i in (1, 2, 3)]
    return rounded(files.union_sources(lists))


@query(f"with {TRUTH} select s1, rid from tr")
def truth_pairs(spark, d):
    return files.truth_pairs(table(spark, d, "train_matches"))


@query(
    f"with {TRUTH}, x as (select s1, string_agg(rid, ',' order by rid) as ids from tr group by s1), a as (select distinct entity_id from prepared where src = 1 and split = 'train') "
    "select entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from a left join x on x.s1 = entity_id"
)
def id_lists(spark, d):
    all_s1 = table(spark, d, "prepared", "entity_id", "src", "split").where("src = 1 and split = 'train'").select(F.col("entity_id").alias("s1"))
    return files.id_lists(files.truth_pairs(table(spark, d, "train_matches")), all_s1)


@query("select * from (select c_custkey as k, c_name as name, c_acctbal as balance, null::varchar as extra from customer union all select s_suppkey, s_name, null, 'supplier' from supplier)")
def union_relaxed(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra"))
    return files.union_relaxed([a, b])


@query(f"with {EXACT} select a.entity_id as s1, b.entity_id as rid from ex join prepared a on a.gid = ex.s1 join prepared b on b.gid = ex.rid")
def entity_ids(spark, d):
    p = table(spark, d, "prepared", "gid", "entity_id", "country", "name_key", "src")
    return files.to_entity_ids(blocking.unique_key_link(p), p)


@query("select country, src::bigint as src, count(*) as n, count_if(addr = '')::bigint as n_blank, count(distinct name_key) as n_keys from prepared where split = 'test' and country = 'France' group by country, src")
def pruned_scan(spark, d):
    p = table(spark, d, "prepared", "country", "src", "addr", "name_key", "split").where("split = 'test' and country = 'France'")
    return rounded(p.groupBy("country", "src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("addr") == "").alias("n_blank"), F.countDistinct("name_key").alias("n_keys")))


# Text


@query()
def text_norm(spark, d):
    return tx.add_norm(table(spark, d, "records", "row_id", "name", "addr")).select("row_id", "name_norm", "name_key", "addr_norm", "addr_nums")


_FINER = f"list_filter({words_sql('addr_roman', tx.FINER_ADDRESS_WORDS)}, lambda x: x <> '' and x not in ({', '.join(repr(w) for w in tx.FILLER_WORDS)}))"
_ONCE = "list_transform(list_sort(list_transform(list_distinct({l}), lambda e: struct_pack(k := list_position({l}, e), v := e))), lambda e: e.v)"
_SOUND = "name_key"
for _a, _b in tx.SOUND_RULES:
    _SOUND = f"replace({_SOUND}, '{_a}', '{_b}')"
for _c in "abcdefghijklmnopqrstuvwxyz":
    _SOUND = f"regexp_replace({_SOUND}, '{_c}+', '{_c}', 'g')"


@query(f"select gid, array_to_string({words_sql('addr_roman', tx.ADDRESS_WORDS)}, ' ') as addr_norm from prepared")
def address_words(spark, d):
    return table(spark, d, "prepared", "gid", "addr_roman").select("gid", tx.map_words(F.col("addr_roman"), tx.ADDRESS_WORDS).alias("addr_norm"))


@query(f"with f as (select gid, {_FINER} as l from prepared) select gid, coalesce(array_to_string({_ONCE.format(l='l')}, ' '), '') as addr2 from f")
def finer_address(spark, d):
    return table(spark, d, "prepared", "gid", "addr_roman").select("gid", tx.finer_address(F.col("addr_roman")).alias("addr2"))


@query(
    "with f as (select gid, list_transform(regexp_extract_all(addr_roman, '[0-9]+'), lambda n: case when ltrim(n, '0') = '' then '0' else ltrim(n, '0') end) as l from prepared) "
    f"select gid, coalesce(array_to_string({_ONCE.format(l='l')}, ' '), '') as nums_z from f"
)
def plain_numbers(spark, d):
    return table(spark, d, "prepared", "gid", "addr_roman").select("gid", tx.plain_numbers(F.col("addr_roman")).alias("nums_z"))


@query(f"select gid, {_SOUND} as name_phon from prepared")
def sound_key(spark, d):
    return table(spark, d, "prepared", "gid", "name_key").select("gid", tx.sound_key(F.col("name_key")).alias("name_phon"))


@query(
    "select gid, len(list_filter(string_split(name_roman, ' '), lambda t: regexp_matches(t, '[\\x{0900}-\\x{0DFF}]')))::bigint as n_indic, regexp_matches(name, '[\\x{0900}-\\x{0DFF}]') as indic, "
    "nullif(regexp_extract(addr_roman, '\\b([1-9][0-9]{5})\\b', 1), '') as pin, length(name)::bigint as n_chars, lower(name) = name as is_lower from prepared"
)
def text_flags(spark, d):
    p = table(spark, d, "prepared", "gid", "name", "name_roman", "addr_roman")
    return rounded(
        p.select(
            "gid", tx.indic_words(F.col("name_roman")).alias("n_indic"), tx.has_indic(F.col("name")).alias("indic"), tx.pin_code(F.col("addr_roman")).alias("pin"),
            F.char_length("name").alias("n_chars"), (F.lower("name") == F.col("name")).alias("is_lower"),
        )
    )


@query()
def learn_romanisation(spark, d):
    p = table(spark, d, "prepared", "gid", "entity_id", "name", "name_roman")
    t = files.truth_pairs(table(spark, d, "train_matches"))
    a, b = p.select(F.col("entity_id").alias("s1"), F.col("name_roman").alias("l")), p.select(F.col("entity_id").alias("rid"), tx.clean(F.col("name")).alias("r"))
    return rounded(translit.learn_table(translit.aligned_words(t.join(a, "s1").join(b, "rid"), "l", "r")))


@query()
def apply_romanisation(spark, d):
    p = table(spark, d, "prepared", "gid", "name").select("gid", tx.clean(F.col("name")).alias("name_norm"))
    return translit.add_roman(p, table(spark, d, "translit_table", "ind", "lat"), {"name_norm": "name_roman"}, "gid")


@query()
def prepared_records(spark, d):
    """The raw deliveries prepared from the start, with the given romanisations."""
    return prepare.prepared(table(spark, d, "records", "entity_id", "name", "addr", "country", "src"), table(spark, d, "translit_table", "ind", "lat")).drop("gid")


# Similarities


_PLAIN = "regexp_replace({}.name_key, '[^a-z0-9]', '', 'g')"
_A, _B = _PLAIN.format("a"), _PLAIN.format("b")


_EDIT = f"levenshtein({_A}, {_B})::bigint as lev, round(case when {_A} = '' and {_B} = '' then 1.0 else jaro_winkler_similarity({_A}, {_B}) end, 6) as jw"
_CP = "cp as (select distinct s1, rid from cands where s1 is not null and rid is not null)"


def _edit_similarity(spark, d, pairs: DataFrame) -> DataFrame:
    p = table(spark, d, "prepared", "gid", "name_key").select("gid", F.regexp_replace("name_key", "[^a-z0-9]", "").alias("plain"))
    df = features.sides(pairs, p, ["plain"])
    return rounded(df.select("s1", "rid", F.levenshtein("a_plain", "b_plain").alias("lev"), sim.jaro_winkler(F.col("a_plain"), F.col("b_plain")).alias("jw")))


@query(f"with {TRUTH_GID} select tg.s1, tg.rid, {_EDIT} from tg join prepared a on a.gid = tg.s1 join prepared b on b.gid = tg.rid")
def edit_similarity(spark, d):
    """Edit distance and Jaro-Winkler of the plain letters and digits of the keys, over the labelled pairs."""
    return _edit_similarity(spark, d, _truth_gid(spark, d))


@query(f"with {_CP} select cp.s1, cp.rid, {_EDIT} from cp join prepared a on a.gid = cp.s1 join prepared b on b.gid = cp.rid")
def edit_similarity_cands(spark, d):
    """``edit_similarity`` of every candidate pair."""
    return _edit_similarity(spark, d, _pairs(spark, d))


@query()
def ratio_similarity(spark, d):
    df = features.sides(_pairs(spark, d), table(spark, d, "prepared", "gid", "name_roman"), ["name_roman"])
    a, b = F.col("a_name_roman"), F.col("b_name_roman")
    return rounded(df.select("s1", "rid", sim.ratio(a, b).alias("ratio"), sim.partial_ratio(a, b).alias("partial"), sim.token_sort_ratio(a, b).alias("tsort"), sim.token_set_ratio(a, b).alias("tset")))


def _truth_gid(spark, d) -> DataFrame:
    p = table(spark, d, "prepared", "gid", "entity_id")
    t = files.truth_pairs(table(spark, d, "train_matches"))
    return t.join(p.select(F.col("entity_id").alias("s1"), F.col("gid").alias("a")), "s1").join(p.select(F.col("entity_id").alias("rid"), F.col("gid").alias("b")), "rid").select(F.col("a").alias("s1"), F.col("b").alias("rid"))


# Blocking


@query(f"with {EXACT} select s1, rid from ex")
def exact_key_link(spark, d):
    return blocking.unique_key_link(table(spark, d, "prepared", "gid", "country", "name_key", "src"))


_FIRST = "nullif(string_split(addr_nums, ' ')[1], '')"


@query(
    f"with r as (select country, name_key, gid, src, {_FIRST} as f from prepared where name_key <> ''), k as (select country, name_key from r where src = 1 group by country, name_key having count(*) <= 20), "
    "a as (select * from r where src = 1), b as (select * from r where src <> 1) "
    "select a.gid as s1, b.gid as rid from a join k using (country, name_key) join b using (country, name_key) union select a.gid, b.gid from a join b using (country, name_key, f)"
)
def exact_bucket_pairs(spark, d):
    return blocking.exact_pairs(table(spark, d, "prepared", "gid", "country", "name_key", "addr_nums", "src"))


_GRAMS = (
    "t0 as (select country, gid, src, name_key as x from prepared where name_key <> ''), g as (select country, gid, src, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) as gram from t0 where length(x) >= 3), "
    "tf as (select country, gid, src, gram, count(*) as tf from g group by all), n as (select country, count(*) as n from t0 group by country), df as (select country, gram, count(*) as df from tf group by all), "
    "idf as (select country, gram, ln((1 + n) / (1 + df)) + 1 as idf from df join n using (country) where df >= 2 and df <= 0.5 * n), raw as (select country, gid, src, gram, (1 + ln(tf)) * idf as w from tf join idf using (country, gram)), "
    "nm as (select country, gid, sqrt(sum(w * w)) as norm from raw group by all), v as (select country, gid, src, gram, w / norm as w from raw join nm using (country, gid)), "
    "sc as (select country, a.gid as q, b.gid as i, round(sum(a.w * b.w), 4) as score from v a join v b using (country, gram) where a.src <> 1 and b.src = 1 group by all having round(sum(a.w * b.w), 4) > 0)"
)


@query(f"with {_GRAMS}, r as (select *, row_number() over (partition by country, q order by score desc, i) as rank from sc) select country, q, i, score, rank from r where rank <= 3")
def topk_name_join(spark, d):
    p = table(spark, d, "prepared", "gid", "country", "src", "name_key")
    rows, fields = blocking.by_key(p, "country", "gid", ["name_key"], F.col("src")), {"name_key": False}
    return rounded(blocking.topk_texts(rows.where("src <> 1"), rows.where("src = 1"), blocking.gram_weights(rows, "country", fields), 3, "country", "gid", fields, digits=4))


@query()
def retrieve_candidates(spark, d):
    return blocking.retrieve(table(spark, d, "prepared", "gid", "country", "src", "name_key", "addr_roman"))


@query(f"with {WIDE} select *, ({HITS})::bigint as blk_n_hits from w")
def candidates_wide(spark, d):
    return rounded(blocking.union_wide(table(spark, d, "cands")), 9)


_BEST = "coalesce(greatest(" + ", ".join(f"blk_{r}_score" for r in blocking.RETRIEVERS) + "), 0)"


@query(
    f"with {WIDE}, b as (select s1, rid, {_BEST} as best from w) select s1, rid, count(*) over (partition by s1) as s1_n_cands, row_number() over (partition by s1 order by best desc, rid) as s1_rank_best, "
    "round(best - max(best) over (partition by s1), 6) as s1_gap_best from b"
)
def candidate_competition(spark, d):
    return rounded(blocking.with_competition(blocking.union_wide(table(spark, d, "cands"))).select("s1", "rid", "s1_n_cands", "s1_rank_best", "s1_gap_best"))


@query(
    f"with {TRUTH_GID}, c as (select distinct s1, rid, lower(retriever) as retriever from cands where s1 is not null and rid is not null), f as (select s1, rid, count(*) as k from c group by all), "
    "h as (select c.*, (tg.s1 is not null)::int as hit, k from c left join tg using (s1, rid) join f using (s1, rid)), t as (select count(*) as total from tg), "
    "u as (select retriever, count(*) as n_cands, sum(hit)::bigint as n_true, count_if(hit = 1 and k = 1)::bigint as alone from h group by retriever "
    "union all select 'all', count(*), sum(hit)::bigint, 0 from (select distinct s1, rid, hit from h)) select retriever, n_cands, n_true, round(n_true / total, 6) as recall, alone from u, t"
)
def blocking_recall(spark, d):
    return rounded(blocking.recall_report(table(spark, d, "cands"), _truth_gid(spark, d)))


@query(f"with {TRUTH_GID} select s1, rid from tg except select s1, rid from cands")
def missed_pairs(spark, d):
    return blocking.missed(_truth_gid(spark, d), table(spark, d, "cands", "s1", "rid"))


@query()
def missed_diagnosis(spark, d):
    return blocking.diagnose(missed_pairs(spark, d), table(spark, d, "prepared", "gid", "name_roman", "addr_roman"))


# Features


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect(string_split({a}, ' '), string_split({b}, ' ')))"


def _uni(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' '))))"


def _own(a: str) -> str:
    return f"len(list_distinct(string_split({a}, ' ')))"


_PAIR_SQL = ", ".join(
    [
        "(a.name_key = b.name_key)::bigint as name_key_eq",
        f"round({_inter('a.name_roman', 'b.name_roman')} / {_own('a.name_roman')}, 6) as name_cont_a", f"round({_inter('a.name_roman', 'b.name_roman')} / {_own('b.name_roman')}, 6) as name_cont_b",
        f"round({_inter('a.name_roman', 'b.name_roman')} / {_uni('a.name_roman', 'b.name_roman')}, 6) as name_jac", f"{_own('a.name_roman')}::bigint as name_ntok_a", f"{_own('b.name_roman')}::bigint as name_ntok_b",
        "(length(a.name_key) - length(b.name_key))::bigint as key_len_diff",
        *(f"case when b.addr_roman <> '' then round({x}, 6) end as {n}" for n, x in (
            ("addr_cont_a", f"{_inter('a.addr_roman', 'b.addr_roman')} / {_own('a.addr_roman')}"), ("addr_cont_b", f"{_inter('a.addr_roman', 'b.addr_roman')} / {_own('b.addr_roman')}"),
            ("addr_jac", f"{_inter('a.addr_roman', 'b.addr_roman')} / {_uni('a.addr_roman', 'b.addr_roman')}"))),
        f"case when a.addr_nums <> '' and b.addr_nums <> '' then round({_inter('a.addr_nums', 'b.addr_nums')} / {_uni('a.addr_nums', 'b.addr_nums')}, 6) end as addr_num_jac",
        "case when a.addr_nums <> '' and b.addr_nums <> '' then (split_part(a.addr_nums, ' ', 1) = split_part(b.addr_nums, ' ', 1))::bigint end as addr_num_first_eq",
        "(b.addr_nums <> '')::bigint as rec_has_nums", "(b.addr_roman = '')::bigint as rec_addr_empty", "b.src::bigint as rec_src", "b.n_indic_unknown::bigint as rec_indic_unknown",
        "regexp_matches(b.name, '[\\x{0900}-\\x{0DFF}]')::bigint as rec_indic", "regexp_matches(b.name, '(?i)\\.(com|in|net|org|co|fr)\\b')::bigint as rec_domain", "regexp_matches(b.name, '^\\s*(<<|>>|--)')::bigint as rec_junk",
        "regexp_matches(b.name, '[()\\[\\]]')::bigint as rec_paren", "contains(b.name, '  ')::bigint as rec_dblspace", "(lower(b.name) = b.name)::bigint as rec_lower", "regexp_matches(a.name, '^\\s*(<<|>>|--)')::bigint as s1_junk",
    ]
)
def _pairs(spark, d) -> DataFrame:
    return table(spark, d, "cands", "s1", "rid").where("s1 is not null and rid is not null").distinct()


@query(f"with {_CP} select cp.s1, cp.rid, {_PAIR_SQL} from cp join prepared a on a.gid = cp.s1 join prepared b on b.gid = cp.rid")
def pair_features_native(spark, d):
    # The edit distance of the keys has its own query: other engines count bytes in it.
    return rounded(features.native_pair_features(_pairs(spark, d), table(spark, d, "prepared")).drop("key_lev"))


@query()
def pair_features(spark, d):
    return rounded(features.pair_features(_pairs(spark, d), table(spark, d, "prepared")))


@query()
def pair_features_finer(spark, d):
    p = table(spark, d, "prepared")
    return rounded(features.finer_pair_features(_pairs(spark, d), features.record_columns(p)))


_LEGAL = ", ".join(repr(w) for w in tx.LEGAL_FORMS)


@query(
    f"with t as (select gid, src, unnest(string_split(name_roman, ' ')) as t from prepared), w as (select * from t where length(t) >= 2 and t not in ({_LEGAL})), v as (select t, count(distinct gid) as f from w where src = 1 group by t) "
    "select gid, round(avg((coalesce(f, 0) > 0)::int), 6) as vocab_share, round(ln(1 + min(coalesce(f, 0))), 6) as min_tok_logf from w left join v using (t) group by gid"
)
def word_familiarity(spark, d):
    return rounded(features.word_familiarity(table(spark, d, "prepared", "gid", "src", "name_roman")))


@query(
    "with n as (select count(*) as n from prepared), t as (select 'n' as kind, unnest(list_distinct(string_split(name_roman, ' '))) as t from prepared union all select 'a', unnest(list_distinct(string_split(addr_roman, ' '))) from prepared) "
    "select kind, t, round(ln(any_value(n)) - ln(count(*) + 1), 6) as idf from t, n where length(t) >= 2 group by kind, t"
)
def token_idf(spark, d):
    return rounded(features.token_idf(table(spark, d, "prepared", "name_roman", "addr_roman")))


@query(
    f"with {SCORES} select s1, rid, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) as s3_logit, rank() over (partition by s1 order by p desc) as s3_rank, "
    "round(max(p) over (partition by s1) - p, 6) as s3_gap_best, round(sum(p) over (partition by s1), 6) as s3_sum, (count(*) filter (p >= 0.5) over (partition by s1))::bigint as s3_n_05, "
    "(count(*) filter (p >= 0.9) over (partition by s1))::bigint as s3_n_09, round(coalesce(nth_value(p, 2) over (partition by s1 order by p desc, rid rows between unbounded preceding and unbounded following), p), 6) as s3_second from sc"
)
def s1_context(spark, d):
    return rounded(features.s1_context(scores(spark, d)).drop("country", "p"))


@query(
    f"with {SCORES}, x as (select *, row_number() over (partition by rid order by p desc, s1) as n from sc), t as (select rid, max(p) as b1, coalesce(max(case when n = 2 then p end), 0) as b2, count(*) as c, sum(p) as s from x group by rid), "
    "o as (select x.*, c, s, case when p >= b1 then b2 else b1 end as other from x join t using (rid)) "
    "select s1, rid, c as r_n_claim, round(s, 6) as r_sum, round(other, 6) as r_max_other, round(p - other, 6) as r_gap_other, rank() over (partition by rid order by p desc) as r_rank from o"
)
def record_context(spark, d):
    return rounded(features.record_context(scores(spark, d)).drop("country", "p"))


@query()
def group_context(spark, d):
    return rounded(features.group_context(scores(spark, d), table(spark, d, "prepared", "gid", "src", "name_roman", "addr_roman")))


_RARE = (
    f"with {SCORES}, tgt as (select s1, rid from sc where p > 0.001 and p < 0.999), n as (select count(*) as n from prepared), wd as (select gid, 'n' as kind, unnest(list_distinct(string_split(name_roman, ' '))) as t from prepared "
    "union all select gid, 'a', unnest(list_distinct(string_split(addr_roman, ' '))) from prepared), df as (select kind, t, ln(any_value(n)) - ln(count(*) + 1) as idf from wd, n where length(t) >= 2 group by kind, t), "
    "wi as (select gid, kind, t, idf from wd join df using (kind, t)), sd as (select s1, rid, kind, t, idf, 1 as side from tgt join wi on gid = s1 union all select s1, rid, kind, t, idf, 2 from tgt join wi on gid = rid), "
    "b as (select s1, rid, kind, t, max(idf) as idf, min(side) as lo, max(side) as hi from sd group by s1, rid, kind, t), su as (select s1, rid, kind, sum(idf) as u, coalesce(sum(idf) filter (lo = 1), 0) as a, "
    "coalesce(sum(idf) filter (lo = 1 and hi = 2), 0) as i, max(idf) filter (lo = 1 and hi = 2) as r, count(*) filter (lo = 1 and hi = 2 and idf > 8) as c from b group by s1, rid, kind), "
    "pn as (select gid, nullif(regexp_extract(addr_roman, '\\b([1-9][0-9]{5})\\b', 1), '') as pin from prepared) select tgt.s1, tgt.rid, "
    + ", ".join(f"case when {k}.u > 0 then round({k}.i / {k}.u, 6) end as i_{k}_wjac, case when {k}.a > 0 then round({k}.i / {k}.a, 6) end as i_{k}_wcov, round({k}.r, 6) as i_{k}_rarest, coalesce({k}.c, 0)::bigint as i_{k}_nrare" for k in "na")
    + ", (pa.pin <> pb.pin)::bigint as i_pin_conflict from tgt left join su n on n.s1 = tgt.s1 and n.rid = tgt.rid and n.kind = 'n' left join su a on a.s1 = tgt.s1 and a.rid = tgt.rid and a.kind = 'a' "
    "left join pn pa on pa.gid = tgt.s1 left join pn pb on pb.gid = tgt.rid"
)


@query(_RARE)
def rare_words(spark, d):
    return rounded(features.rare_word_features(scores(spark, d), table(spark, d, "prepared", "gid", "name_roman", "addr_roman")))


@query(f"with {SCORES}, x as (select s1, rid, p from sc where p > 0.02 and p < 0.98), y as (select s1, rid as rc from sc where p >= 0.5) select x.s1, x.rid, count(*) as n_sure from x join y on x.s1 = y.s1 and x.rid <> y.rc group by x.s1, x.rid")
def sure_siblings(spark, d):
    s = scores(spark, d)
    target, sure = s.where(features.in_band("p", features.GROUP_BAND)).select("s1", "rid"), s.where("p >= 0.5").select("s1", F.col("rid").alias("rc"))
    return target.join(sure, "s1").where("rid <> rc").groupBy("s1", "rid").agg(F.count(F.lit(1)).alias("n_sure"))


# Decisions


@query(f"with {SCORES} select s1, rid, round(p / greatest(1, sum(p) over (partition by rid)), 6) as pn from sc")
def normalised_scores(spark, d):
    return rounded(decide.column_normalize(scores(spark, d)).select("s1", "rid", "pn"))


@query(f"with {SCORES} select s1, rid from sc where p >= 0.7")
def rule_threshold(spark, d):
    return decide.apply_rule(scores(spark, d), "thr0.7")


_OWNED = f"{SCORES}, ow as (select * from (select *, row_number() over (partition by rid order by p desc, s1) as n from sc) where n = 1)"


@query(f"with {_OWNED} select s1, rid from ow where p >= 0.7")
def rule_one_owner(spark, d):
    return decide.apply_rule(scores(spark, d), "greedy0.7")


@query(f"with {_OWNED}, c as (select gid, country as co from prepared) select s1, rid from ow left join c on c.gid = s1 where p >= case when co = 'France' then 0.85 else 0.7 end")
def rule_by_country(spark, d):
    countries = table(spark, d, "prepared", "gid", "country").select(F.col("gid").alias("s1"), "country")
    return decide.apply_rule(scores(spark, d).drop("country"), "greedy0.7|France:0.85", countries)


@query(
    f"with {SCORES}, n as (select s1, rid, p / greatest(1, sum(p) over (partition by rid)) as pn from sc), k as (select *, row_number() over (partition by s1 order by pn desc, rid) as k, "
    "sum(pn) over (partition by s1 order by pn desc, rid rows unbounded preceding) as cum, sum(pn) over (partition by s1) as tot, sum(case when pn < 1 then ln(1 - pn) end) over (partition by s1) as e, max(pn) over (partition by s1) as m from n), "
    "g as (select *, 1.25 * cum / (k + 0.25 * tot) as gain, case when m >= 1 then 0 else exp(e) end as e0 from k where k <= 12), b as (select s1, max(gain) as best from g group by s1), "
    "s as (select s1, min(k) as ks from g join b using (s1) where gain = best and best > e0 group by s1) select g.s1, g.rid from g join s using (s1) where k <= ks"
)
def rule_expected_f(spark, d):
    return decide.apply_rule(scores(spark, d), "expF")


@query(f"with {SCORES} select s1, rid from sc where p > 0.001 and p < 0.999 and not (p > 0.01 and p < 0.99)")
def band_difference(spark, d):
    return scores(spark, d).where(features.between_bands("p", features.IDF_BAND, (0.01, 0.99))).select("s1", "rid")


@query(f"with {SCORES} select s1, rid, round(abs(p - 1 / (1 + exp(-(4 * p - 1)))), 6) as dis_ce from sc where p > 0.02 union all select s1, rid, null from sc where p <= 0.02")
def score_disagreement(spark, d):
    s = scores(spark, d).withColumn("ce", F.when(F.col("p") > 0.02, 4 * F.col("p") - 1))
    return rounded(s.select("s1", "rid", features.disagreement().alias("dis_ce")))


@query(f"with {SCORES}, {WIDE}, b as (select s1, rid, {_BEST} as best from w) select s1, rid, round(p, 6) as p from sc join b using (s1, rid) where best >= 0.5")
def candidate_cut(spark, d):
    best = F.coalesce(F.greatest(*(F.col(f"blk_{r}_score") for r in blocking.RETRIEVERS)), F.lit(0.0))
    first = blocking.union_wide(table(spark, d, "cands")).select("s1", "rid", best.cast("double").alias("p1"))
    return rounded(decide.cut_candidates(scores(spark, d), first, 0.5).select("s1", "rid", "p"))


@query(f"with {SCORES} select s1, rid, country, round(case when country = 'France' then p else p * p end, 6) as p from sc")
def merged_countries(spark, d):
    s = scores(spark, d)
    return rounded(decide.merge_by_country(s, s.withColumn("p", F.col("p") * F.col("p")), ["France"]))


_RULES = ["thr0.3", "thr0.6", "greedy0.3", "greedy0.6"]


@query(
    f"with {TRUTH_GID}, {WIDE}, la as (select distinct a.gid as s1, a.country as co from train_matches m join prepared a on a.entity_id = trim(m.source1_entity_id)), b as (select s1, rid, {_BEST} as p from w), "
    "o as (select * from (select *, row_number() over (partition by rid order by p desc, s1) as n from b) where n = 1), pr as ("
    + " union all ".join(f"select '{r}' as rule, s1, rid from {'b' if r.startswith('thr') else 'o'} where p >= {r[3:] if r.startswith('thr') else r[6:]}" for r in _RULES)
    + "), ru as (select unnest([" + ", ".join(f"'{r}'" for r in _RULES) + "]) as rule), np as (select rule, s1, count(*) as n_pred from pr group by rule, s1), nt as (select s1, count(*) as n_true from tg group by s1), "
    "hp as (select rule, s1, count(*) as tp from pr join tg using (s1, rid) group by rule, s1), pe as (select ru.rule, la.s1, la.co, coalesce(n_pred, 0) as n_pred, "
    "case when n_pred is null and n_true is null then 1.0 else 1.25 * coalesce(tp, 0) / (coalesce(n_pred, 0) + 0.25 * coalesce(n_true, 0)) end as f from ru cross join la left join np on np.rule = ru.rule and np.s1 = la.s1 "
    "left join nt on nt.s1 = la.s1 left join hp on hp.rule = ru.rule and hp.s1 = la.s1), bc as (select rule, co, avg(f) as f from pe group by rule, co), m(co, w) as (values ('US', 0.383), ('India', 0.467), ('France', 0.150)), "
    "mx as (select rule, sum(f * w) / sum(w) as mixed from bc join m using (co) group by rule) select rule, round(avg(f), 6) as macro_f05, round(any_value(mixed), 6) as mixed_f05, sum(n_pred)::bigint as n_pred from pe join mx using (rule) group by rule"
)
def rule_sweep(spark, d):
    best = F.coalesce(F.greatest(*(F.col(f"blk_{r}_score") for r in blocking.RETRIEVERS)), F.lit(0.0))
    pairs = blocking.union_wide(table(spark, d, "cands")).select("s1", "rid", best.cast("double").alias("p"))
    return rounded(decide.sweep_rules(pairs, _truth_gid(spark, d), _labelled_s1(spark, d), _RULES, MIX))


def _labelled_s1(spark, d) -> DataFrame:
    p = table(spark, d, "prepared", "gid", "entity_id", "country").select(F.col("gid").alias("s1"), "entity_id", "country")
    lists = table(spark, d, "train_matches", "source1_entity_id").select(F.trim("source1_entity_id").alias("entity_id")).distinct()
    return p.join(lists, "entity_id", "left_semi").select("s1", "country")


# Metrics and checks


_ALL = "al as (select gid as s1, country as co from prepared where src = 1 and split = 'train')"
_PER = (
    f"{EXACT}, {TRUTH_GID}, {_ALL}, pr as (select s1, count(*) as n_pred from ex group by s1), tn as (select s1, count(*) as n_true from tg group by s1), hp as (select s1, count(*) as tp from ex join tg using (s1, rid) group by s1), "
    "pe as (select s1, co, coalesce(n_pred, 0) as n_pred, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp, case when n_pred is null and n_true is null then 1.0 else 1.25 * coalesce(tp, 0) / (coalesce(n_pred, 0) + 0.25 * coalesce(n_true, 0)) end as f05 "
    "from al left join pr using (s1) left join tn using (s1) left join hp using (s1))"
)


def _per_entity(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "prepared", "gid", "country", "name_key", "src", "split")
    all_s1 = p.where("src = 1 and split = 'train'").select(F.col("gid").alias("s1"), "country")
    return metric.per_entity_f05(blocking.unique_key_link(p), _truth_gid(spark, d), all_s1), all_s1


@query(f"with {_PER} select s1, n_pred, n_true, tp, round(f05, 6) as f05 from pe")
def entity_f05(spark, d):
    return rounded(_per_entity(spark, d)[0])


@query(
    f"with {_PER}, b as (select *, case when n_true = 0 then '0' when n_true <= 3 then '1-3' else '4+' end as bucket from pe), "
    "u as (select 'all' as level, '' as value, * from b union all select 'country', co, * from b union all select 'bucket', bucket, * from b) "
    "select level, value, count(*) as n_s1, round(avg(f05), 6) as macro_f05, round(sum(tp) / nullif(sum(n_pred), 0), 6) as precision, round(sum(tp) / nullif(sum(n_true), 0), 6) as recall, round(avg(n_pred), 6) as pred_per_s1 from u group by level, value"
)
def link_exact_report(spark, d):
    return rounded(metric.report(*_per_entity(spark, d)))


#: Shares of the countries in the scored set (fixed values).
MIX = {"US": 0.383, "India": 0.467, "France": 0.150}


@query(f"with {_PER}, b as (select co, avg(f05) as f from pe group by co), m(co, w) as (values ('US', 0.383), ('India', 0.467), ('France', 0.150)) select round(sum(f * w) / sum(w), 6) as mixed_f05 from b join m using (co)")
def mixed_report(spark, d):
    return rounded(metric.mixed_f05(*_per_entity(spark, d), MIX))


@query(
    f"with r as (select source1_entity_id as s1, coalesce(matched_entity_ids, '') as ids from train_matches), i as (select s1, trim(x) as rid from (select s1, unnest(string_split(ids, ',')) as x from r) where trim(x) <> ''), "
    "a as (select distinct entity_id as s1 from prepared where src = 1 and split = 'train'), u as (select 'duplicate_row' as error, (select count(*) from (select s1 from r group by s1 having count(*) > 1)) as n "
    "union all select 'missing_s1', (select count(*) from a where not exists (select 1 from r where r.s1 = a.s1)) union all select 'extra_s1', (select count(*) from (select distinct s1 from r) q where not exists (select 1 from a where a.s1 = q.s1)) "
    "union all select 'duplicate_id', (select count(*) from (select s1, rid from i group by s1, rid having count(*) > 1)) union all select 'self_match', (select count(*) from i where s1 = rid) "
    "union all select 'wrong_prefix', (select count(*) from i where not starts_with(rid, 'S2-') and not starts_with(rid, 'S3-')) "
    "union all select 'unknown_id', (select count(*) from (select distinct rid from i) q where not exists (select 1 from prepared p where p.entity_id = q.rid))) select error, n from u where n > 0"
)
def check_lists(spark, d):
    p = table(spark, d, "prepared", "entity_id", "src", "split")
    return rounded(metric.check_id_lists(table(spark, d, "train_matches"), p.where("src = 1 and split = 'train'").select(F.col("entity_id").alias("s1")), p))


@query(f"with {_OWNED} select s1, rid from ow where p >= 0.7 except select s1, rid from cands")
def check_matches_are_candidates(spark, d):
    return metric.check_subset(decide.apply_rule(scores(spark, d), "greedy0.7"), table(spark, d, "cands", "s1", "rid"))


# Folds, samples, models


_HASH = "('0x' || substr(md5('0:' || {k}::varchar), 1, 8))::bigint"


@query(f"select gid, ({_HASH.format(k='gid')} % 3)::bigint as fold from prepared where src = 1")
def hash_folds(spark, d):
    return rounded(table(spark, d, "prepared", "gid", "src").where("src = 1").select("gid", sampling.fold("gid").alias("fold")))


@query(f"select gid, case when {_HASH.format(k='gid')} < 1288490188 then 'sample' else 'rest' end as part from prepared")
def sample_and_rest(spark, d):
    p = table(spark, d, "prepared", "gid")
    return sampling.sample_fraction(p, "gid", 0.3).withColumn("part", F.lit("sample")).unionByName(sampling.sample_rest(p, "gid", 0.3).withColumn("part", F.lit("rest")))


@query(f"with {SCORES} select s1, rid, round(p, 6) as p from (select *, row_number() over (partition by s1 order by p desc, rid) as n from sc) where n <= 25")
def pruned_candidates(spark, d):
    return rounded(models.prune(scores(spark, d)).select("s1", "rid", "p"))


@query(f"with {SCORES}, ow as (select *, row_number() over (partition by rid order by p desc, s1) as n from sc where country = 'France') select s1, rid, case when p >= 0.97 then 1 else 0 end::bigint as label from ow where (p >= 0.97 and n = 1) or p <= 0.03")
def pseudo_labels(spark, d):
    return rounded(models.pseudo_label(scores(spark, d), ["France"]).select("s1", "rid", "label"))


def _labelled(spark, d) -> DataFrame:
    wide = blocking.with_competition(blocking.union_wide(table(spark, d, "cands")))
    train = table(spark, d, "prepared", "gid", "src", "split").where("src = 1 and split = 'train'").select(F.col("gid").alias("s1"))
    return wide.join(train, "s1").join(_truth_gid(spark, d).withColumn("label", F.lit(1)), ["s1", "rid"], "left").fillna(0, ["label"])


_STAGE1 = [f"blk_{r}_{x}" for r in blocking.RETRIEVERS for x in ("rank", "score")] + ["blk_n_hits", "s1_n_cands", "s1_rank_best", "s1_gap_best"]


@query()
def oof_scores(spark, d):
    return models.oof_score(_labelled(spark, d), _STAGE1, kind="lr")[0].select("s1", "rid", "label", "fold", "p")


@query()
def fold_averages(spark, d):
    rows = _labelled(spark, d)
    _, fitted = models.oof_score(rows, _STAGE1, kind="gbt", maxIter=5)
    test = blocking.with_competition(blocking.union_wide(table(spark, d, "cands"))).join(rows.select("s1").distinct(), "s1", "left_anti")
    return models.fold_average(fitted, test, _STAGE1).select("s1", "rid", "p")


@query(f"with {SCORES}, a as (select s1, rid, p from sc where p < 0.6), b as (select s1, rid, p * p as p from sc where p > 0.4) select s1, rid, round(avg(p), 6) as ce from (select * from a union all select * from b) group by s1, rid")
def combined_scores(spark, d):
    s = scores(spark, d)
    a, b = s.where("p < 0.6").select("s1", "rid", F.col("p").alias("ce")), s.where("p > 0.4").select("s1", "rid", (F.col("p") * F.col("p")).alias("ce"))
    return rounded(models.combine_scores([a, b]))


@query(f"select gid, ({_HASH.replace('0:', '11:').format(k='gid')} % 3)::bigint as fold from prepared where src = 1")
def inner_folds(spark, d):
    return rounded(table(spark, d, "prepared", "gid", "src").where("src = 1").select("gid", sampling.fold("gid", seed=11).alias("fold")))


@query(f"with c as (select distinct s1, rid from cands where s1 is not null and rid is not null), n as (select count(*) as n from c) select s1, rid from c, n where {_HASH.replace('0:', '3:').format(k='s1')} % 1000 < 1000 * 2000 // n")
def capped_subset(spark, d):
    return sampling.capped_by_key(_pairs(spark, d), "s1", 2000)


def _run(spark, d) -> linkage.Run:
    """A run over the test tables with their candidates, logistic models and no folder of its own."""
    p = table(spark, d, "prepared")
    listed = p.where("src = 1").select(F.col("gid").alias("s1"), "split")
    cands = {s: table(spark, d, "cands").join(listed.where(F.col("split") == s), "s1", "left_semi") for s in ("train", "test")}
    config = linkage.LinkConfig(d, "", "", kind="lr", stage1_share=1.0, mix=MIX)
    return linkage.Run(spark, config, p, p, _truth_gid(spark, d), _labelled_s1(spark, d).select("s1"), cands)


@query()
def stage1_pruned(spark, d):
    return rounded(_run(spark, d).pruned("test").select("s1", "rid", "p1"))


@query()
def stage2_scores(spark, d):
    return rounded(_run(spark, d).scores("train", 2))


@query()
def stage4_choice(spark, d):
    """The rules by their worth on the stacked scores of the labelled rows."""
    return rounded(_run(spark, d).evaluate(4))


# Relational groundwork on the star schema


@query(
    "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as weighted "
    "from lineitem group by l_returnflag, l_linestatus"
)
def aggregate_lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted"),
    )


@query("select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by n_name")
def join_orders(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice").where("o_orderstatus = 'F'")
    c, n = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "nation", "n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders) and c_nationkey in (select n_nationkey from nation where n_regionkey < 3)")
def semi_and_anti_join(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    kept = c.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return kept.join(table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey < 3) and s_nationkey not in (select c_nationkey from customer where c_acctbal > 9900)")
def supplier_semi_and_anti(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    kept = s.join(table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi")
    return kept.join(table(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey")), "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query(
    "select o_orderkey, o_custkey, row_number() over w as place, round(sum(o_totalprice) over (w rows unbounded preceding), 2) as running, round(o_totalprice - max(o_totalprice) over (partition by o_custkey), 2) as gap "
    "from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)"
)
def window_orders(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = Window.partitionBy("o_custkey")
    w = c.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", F.row_number().over(w).cast("bigint").alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.col("o_totalprice") - F.max("o_totalprice").over(c), 2).alias("gap"),
    )


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    from loomlink.streaming.linking import event_counts

    out = event_counts(table(spark, d, "events", "ts", "event_type", "value"))
    return out.withColumn("total", F.round("total", 4))
