"""Features of candidate pairs, of the records themselves, and of the competition around a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlink.functions import similarity as sim
from loomlink.functions import text as tx

#: Open bands of p in which the costly features are computed.
GROUP_BAND, IDF_BAND = (0.02, 0.98), (0.001, 0.999)


def in_band(p, band: tuple[float, float]):
    return (F.col(p) > band[0]) & (F.col(p) < band[1])


def between_bands(p, wide: tuple[float, float], core: tuple[float, float]):
    """Inside the wide band but outside the one in its middle."""
    return in_band(p, wide) & ~in_band(p, core)


def disagreement(p: str = "p", logit: str = "ce"):
    """How far a probability is from another scorer's logit; NULL where that has none."""
    return F.abs(F.col(p) - 1 / (1 + F.exp(-F.col(logit))))


#: Columns that the stacked models see beside the context of p (fixed values).
STACK_BASE = (
    "blk_comb_rev_rank", "blk_comb_rev_score", "rec_addr_empty", "rec_src", "name_key_eq", "name_tset", "addr_tset", "v2_rec_vocab_share", "v2_num_first_eq", "v2_words_tsort", "p1",
)
S1_CONTEXT = ("s3_logit", "s3_rank", "s3_gap_best", "s3_sum", "s3_n_05", "s3_n_09", "s3_second")
RECORD_CONTEXT = ("r_n_claim", "r_sum", "r_max_other", "r_gap_other", "r_rank")
GROUP_CONTEXT = ("g_name_max", "g_name_mean", "g_addr_max", "g_n_conf", "g_n_conf_same_src")
RARE_WORDS = tuple(f"i_{k}_{x}" for k in "na" for x in ("wjac", "wcov", "rarest", "nrare")) + ("i_pin_conflict",)


def stack_features(stage: int) -> list[str]:
    """The feature list of a stacked model: 3 the S1's and the record's context with the group's, 4 the score of stage 2 as well."""
    base = ["p", *S1_CONTEXT, *STACK_BASE, *RECORD_CONTEXT, "ce", *GROUP_CONTEXT, *RARE_WORDS, "dis_ce"]
    return base if stage == 3 else [*base, "p_s2"]


def stack_frame(scores: DataFrame, records: DataFrame, extra: DataFrame, ce: DataFrame) -> DataFrame:
    """``scores(s1, rid, p)`` of all competitors with their context, the other scorer's logit ``ce`` and the ``extra`` columns of the pair."""
    base = scores.select("s1", "rid", "p")
    df = record_context(s1_context(base)).join(ce.select("s1", "rid", "ce"), ["s1", "rid"], "left")
    for more in (group_context(base, records), rare_word_features(base, records), extra):
        df = df.join(more, ["s1", "rid"], "left")
    return df.withColumn("dis_ce", disagreement())


def sides(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both records, prefixed ``a_`` (s1) and ``b_`` (rid)."""
    side = lambda key, pre: records.select(F.col("gid").alias(key), *(F.col(c).alias(pre + c) for c in columns))
    return pairs.join(side("s1", "a_"), "s1").join(side("rid", "b_"), "rid")


def native_pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The features that need no Python: overlaps, equalities, numbers and flags of the record."""
    df = sides(pairs, records, ["name", "name_roman", "name_key", "addr_roman", "addr_nums", "src", "n_indic_unknown"])
    name, addr = sim.word_overlap(F.col("a_name_roman"), F.col("b_name_roman")), sim.word_overlap(F.col("a_addr_roman"), F.col("b_addr_roman"))
    nums = sim.word_overlap(F.col("a_addr_nums"), F.col("b_addr_nums"))["jac"]
    blank, numbered = F.col("b_addr_roman") == "", (F.col("a_addr_nums") != "") & (F.col("b_addr_nums") != "")
    first = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    flag = lambda c: c.cast("int")
    return df.select(
        *pairs.columns,
        F.levenshtein("a_name_key", "b_name_key").alias("key_lev"),
        flag(F.col("a_name_key") == F.col("b_name_key")).alias("name_key_eq"),
        *(name[k].alias(f"name_{k}") for k in name),
        F.size(F.array_distinct(F.split("a_name_roman", " "))).alias("name_ntok_a"), F.size(F.array_distinct(F.split("b_name_roman", " "))).alias("name_ntok_b"),
        (F.char_length("a_name_key") - F.char_length("b_name_key")).alias("key_len_diff"),
        *(F.when(~blank, addr[k]).alias(f"addr_{k}") for k in addr),
        F.when(numbered, nums).alias("addr_num_jac"), F.when(numbered, flag(first("a_addr_nums") == first("b_addr_nums"))).alias("addr_num_first_eq"),
        flag(F.col("b_addr_nums") != "").alias("rec_has_nums"), flag(blank).alias("rec_addr_empty"), F.col("b_src").cast("int").alias("rec_src"), F.col("b_n_indic_unknown").cast("int").alias("rec_indic_unknown"),
        flag(tx.has_indic(F.col("b_name"))).alias("rec_indic"), flag(F.col("b_name").rlike(tx.DOMAIN_NAME)).alias("rec_domain"),
        flag(F.col("b_name").rlike(tx.JUNK_NAME)).alias("rec_junk"), flag(F.col("b_name").rlike(tx.BRACKETED_NAME)).alias("rec_paren"),
        flag(F.col("b_name").contains("  ")).alias("rec_dblspace"), flag(F.lower("b_name") == F.col("b_name")).alias("rec_lower"), flag(F.col("a_name").rlike(tx.JUNK_NAME)).alias("s1_junk"),
    )


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """All features of a pair: the native ones, the ratios of names, keys and addresses, and the competition by their sum."""
    df = sides(native_pair_features(pairs, records), records, ["name_roman", "name_key", "addr_roman"])
    blank = F.col("b_addr_roman") == ""
    scores = {}
    for pre, column, kinds in (("name", "name_roman", ("ratio", "partial", "tset", "tsort", "jw")), ("key", "name_key", ("ratio", "partial")), ("addr", "addr_roman", ("ratio", "tset", "partial"))):
        for kind in kinds:
            f = {"ratio": sim.ratio, "partial": sim.partial_ratio, "tset": sim.token_set_ratio, "tsort": sim.token_sort_ratio, "jw": sim.jaro_winkler}[kind]
            scores[f"{pre}_{kind}"] = f(F.col("a_" + column), F.col("b_" + column))
    df = df.withColumns(scores).withColumns({c: F.when(~blank, F.col(c)) for c in ("addr_ratio", "addr_tset", "addr_partial")})
    score = (F.col("name_tset") + F.col("key_ratio") + F.coalesce("addr_tset", "name_tset")) / 300
    wanted = [c for c in df.columns if not c.startswith(("a_", "b_"))]
    return add_competition(df.select(*wanted, score.alias("cmp_score")))


def beside(df: DataFrame, key: str, **aggregates) -> DataFrame:
    """``df`` with aggregates over each ``key``, by partial sums and a join: a key with very many rows is never in one task for them."""
    return df.join(df.groupBy(key).agg(*(a.alias(n) for n, a in aggregates.items())), key)


def add_competition(df: DataFrame, score: str = "cmp_score") -> DataFrame:
    """How a pair's ``score`` stands among its S1's candidates; ties in rank by ``rid``."""
    s1, columns = Window.partitionBy("s1"), df.columns
    df = beside(df, "s1", cmp_n_cand_s1=F.count(F.lit(1)), _best=F.max(score), _mean=F.avg(score))
    return df.select(
        *columns, "cmp_n_cand_s1", F.row_number().over(s1.orderBy(F.desc(score), "rid")).alias("cmp_rank_in_s1"), F.rank().over(s1.orderBy(F.desc(score))).alias("cmp_rank_min"),
        (F.col(score) - F.col("_best")).alias("cmp_gap_to_best_s1"), (F.col(score) - F.col("_mean")).alias("cmp_gap_to_mean_s1"),
    )


def record_columns(records: DataFrame) -> DataFrame:
    """``gid, addr2, nums_z, words, name_phon`` and how known a record's name words are among the listed names."""
    df = records.withColumn("addr2", tx.finer_address(F.col("addr_roman")))
    df = df.select("gid", "addr2", tx.plain_numbers(F.col("addr2")).alias("nums_z"), tx.wordy(F.col("addr2")).alias("words"), tx.sound_key(F.col("name_key")).alias("name_phon"))
    return df.join(word_familiarity(records), "gid", "left")


def word_familiarity(records: DataFrame) -> DataFrame:
    """``gid, vocab_share, min_tok_logf``: share of the name's words that a listed name has, and ln(1 + frequency) of its rarest."""
    words = records.select("gid", "src", F.explode(F.split("name_roman", " ")).alias("t")).where((F.char_length("t") >= 2) & ~F.col("t").isin(*tx.LEGAL_FORMS))
    known = words.where("src = 1").groupBy("t").agg(F.countDistinct("gid").alias("f"))
    freq = words.join(known, "t", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    return freq.groupBy("gid").agg(F.avg((F.col("f") > 0).cast("double")).alias("vocab_share"), F.log1p(F.min("f")).alias("min_tok_logf"))


def finer_pair_features(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """``v2_`` features over ``record_columns``."""
    df = sides(pairs.select("s1", "rid"), columns, ["addr2", "nums_z", "words", "name_phon", "vocab_share", "min_tok_logf"])
    an, bn = F.split("a_nums_z", " "), F.split("b_nums_z", " ")
    both = (F.col("a_nums_z") != "") & (F.col("b_nums_z") != "")
    shared = F.size(F.array_intersect(an, bn))
    addressed, worded = F.col("b_addr2") != "", (F.col("a_words") != "") & (F.col("b_words") != "")
    first = lambda x: F.get(x, F.lit(0))
    num = lambda c: F.when(both, c)
    return df.select(
        "s1", "rid",
        num(F.levenshtein(first(an), first(bn))).alias("v2_num_first_lev"), num(sim.partial_ratio(F.col("a_nums_z"), F.col("b_nums_z"))).alias("v2_num_partial"),
        F.when(addressed, sim.token_set_ratio(F.col("a_addr2"), F.col("b_addr2"))).alias("v2_addr2_tset"), F.when(addressed, sim.token_sort_ratio(F.col("a_addr2"), F.col("b_addr2"))).alias("v2_addr2_tsort"),
        F.when(worded, sim.token_sort_ratio(F.col("a_words"), F.col("b_words"))).alias("v2_words_tsort"), F.when(worded, sim.token_set_ratio(F.col("a_words"), F.col("b_words"))).alias("v2_words_tset"),
        F.when(worded, sim.partial_ratio(F.col("a_words"), F.col("b_words"))).alias("v2_words_partial"),
        sim.ratio(F.col("a_name_phon"), F.col("b_name_phon")).alias("v2_phon_ratio"), sim.partial_ratio(F.col("a_name_phon"), F.col("b_name_phon")).alias("v2_phon_partial"),
        (F.col("a_name_phon") == F.col("b_name_phon")).cast("int").alias("v2_phon_eq"),
        num(shared.cast("double") / F.size(F.array_union(an, bn))).alias("v2_num_jac"), num((first(an) == first(bn)).cast("int")).alias("v2_num_first_eq"),
        num(F.array_contains(bn, first(an)).cast("int")).alias("v2_num_a_first_in_b"), num(F.array_contains(an, first(bn)).cast("int")).alias("v2_num_b_first_in_a"),
        num(F.size(an) - shared).alias("v2_num_unmatched_a"), num(F.size(bn) - shared).alias("v2_num_unmatched_b"),
        F.col("b_vocab_share").alias("v2_rec_vocab_share"), F.col("b_min_tok_logf").alias("v2_rec_min_tok_logf"),
    )


def s1_context(df: DataFrame, p: str = "p") -> DataFrame:
    """``s3_`` columns: a pair's ``p`` among its S1's candidates. With one candidate the second best is its own.

    Sums, counts and the best come from partial aggregates; only the rank needs an S1's rows in order.
    """
    s1, columns = Window.partitionBy("s1"), df.columns
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    df = df.withColumn("s3_rank", F.rank().over(s1.orderBy(F.desc(p))))
    df = beside(df, "s1", _best=F.max(p), s3_sum=F.sum(p), s3_n_05=F.count_if(F.col(p) >= 0.5), s3_n_09=F.count_if(F.col(p) >= 0.9), _firsts=F.count_if(F.col("s3_rank") == 1), _next=F.max(F.when(F.col("s3_rank") > 1, F.col(p))))
    second = F.when(F.col("_firsts") > 1, F.col("_best")).otherwise(F.coalesce("_next", "_best"))
    return df.select(*columns, F.log(clipped / (1 - clipped)).alias("s3_logit"), "s3_rank", (F.col("_best") - F.col(p)).alias("s3_gap_best"), "s3_sum", "s3_n_05", "s3_n_09", second.alias("s3_second"))


def record_context(df: DataFrame, p: str = "p") -> DataFrame:
    """``r_`` columns: how strongly other S1s claim the pair's record; 0 if none does."""
    rid = Window.partitionBy("rid")
    df = df.withColumn("_place", F.row_number().over(rid.orderBy(F.desc(p), "s1")))
    first, second = F.max(p).over(rid), F.coalesce(F.max(F.when(F.col("_place") == 2, F.col(p))).over(rid), F.lit(0.0))
    other = F.when(F.col(p) >= first, second).otherwise(first)
    return df.withColumns({"r_n_claim": F.count(F.lit(1)).over(rid), "r_sum": F.sum(p).over(rid), "r_max_other": other, "r_gap_other": F.col(p) - other, "r_rank": F.rank().over(rid.orderBy(F.desc(p)))}).drop("_place")


def group_context(df: DataFrame, records: DataFrame, p: str = "p", band: tuple[float, float] = GROUP_BAND) -> DataFrame:
    """``g_`` columns of the uncertain pairs: likeness of the record with the S1's other records that are sure (p >= 0.5)."""
    target = df.where(in_band(p, band)).select("s1", "rid")
    sure = df.where(F.col(p) >= 0.5).select("s1", F.col("rid").alias("rc"))
    met = target.join(sure, "s1").where("rid <> rc")
    side = lambda key, pre: records.select(F.col("gid").alias(key), *(F.col(c).alias(pre + c) for c in ("src", "name_roman", "addr_roman")))
    met = met.join(side("rid", "t_"), "rid").join(side("rc", "c_"), "rc")
    met = met.withColumn("ns", sim.token_set_ratio(F.col("t_name_roman"), F.col("c_name_roman"))).withColumn(
        "ad", F.when((F.col("t_addr_roman") != "") & (F.col("c_addr_roman") != ""), sim.token_set_ratio(F.col("t_addr_roman"), F.col("c_addr_roman")))
    )
    g = met.groupBy("s1", "rid").agg(
        F.max("ns").alias("g_name_max"), F.avg("ns").alias("g_name_mean"), F.max("ad").alias("g_addr_max"), F.count(F.lit(1)).alias("g_n_conf"), F.count_if(F.col("t_src") == F.col("c_src")).alias("g_n_conf_same_src")
    )
    return target.join(g, ["s1", "rid"], "left").fillna(0, ["g_n_conf", "g_n_conf_same_src"])


def token_idf(records: DataFrame) -> DataFrame:
    """``kind, t, idf``: ln N - ln(df + 1) of the words of two letters or more, in names (n) and addresses (a)."""
    n = records.agg(F.count(F.lit(1)).alias("n"))  # one row
    out = None
    for kind, column in (("n", "name_roman"), ("a", "addr_roman")):
        words = records.select(F.explode(F.array_distinct(F.split(column, " "))).alias("t")).where(F.char_length("t") >= 2)
        part = words.groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select(F.lit(kind).alias("kind"), "t", (F.log("n") - F.log(F.col("df") + 1)).alias("idf"))
        out = part if out is None else out.unionByName(part)
    return out


def rare_word_features(df: DataFrame, records: DataFrame, p: str = "p", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """``i_`` columns of the uncertain pairs: weighted overlap of words, the rarest shared one, and whether the postcodes conflict."""
    target = df.where(in_band(p, band)).select("s1", "rid")
    idf, out = token_idf(records), target
    for kind, column in (("n", "name_roman"), ("a", "addr_roman")):
        words = records.select("gid", F.explode(F.array_distinct(F.split(column, " "))).alias("t")).join(idf.where(F.col("kind") == kind).drop("kind"), "t")
        a, b = target.join(words.withColumnRenamed("gid", "s1"), "s1"), target.join(words.withColumnRenamed("gid", "rid"), "rid")
        both = a.select("s1", "rid", "t", "idf", F.lit(1).alias("side")).unionByName(b.select("s1", "rid", "t", "idf", F.lit(2).alias("side")))
        # One grouping per word says whether both sides have it; a second sums up the pair.
        per = both.groupBy("s1", "rid", "t").agg(F.max("idf").alias("idf"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        shared = (F.col("lo") == 1) & (F.col("hi") == 2)
        sums = per.groupBy("s1", "rid").agg(
            F.sum("idf").alias("usum"), F.coalesce(F.sum(F.when(F.col("lo") == 1, F.col("idf"))), F.lit(0.0)).alias("asum"), F.coalesce(F.sum(F.when(shared, F.col("idf"))), F.lit(0.0)).alias("isum"),
            F.max(F.when(shared, F.col("idf"))).alias(f"i_{kind}_rarest"), F.count_if(shared & (F.col("idf") > 8)).alias(f"i_{kind}_nrare"),
        )
        part = sums.select("s1", "rid", F.when(F.col("usum") > 0, F.col("isum") / F.col("usum")).alias(f"i_{kind}_wjac"), F.when(F.col("asum") > 0, F.col("isum") / F.col("asum")).alias(f"i_{kind}_wcov"), f"i_{kind}_rarest", f"i_{kind}_nrare")
        out = out.join(part, ["s1", "rid"], "left").fillna(0, [f"i_{kind}_nrare"])
    pin = records.select("gid", tx.pin_code(F.col("addr_roman")).alias("pin"))
    out = out.join(pin.select(F.col("gid").alias("s1"), F.col("pin").alias("pa")), "s1", "left").join(pin.select(F.col("gid").alias("rid"), F.col("pin").alias("pb")), "rid", "left")
    return out.withColumn("i_pin_conflict", (F.col("pa") != F.col("pb")).cast("int")).drop("pa", "pb")
