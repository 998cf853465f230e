"""Variant spellings of names: suffix blocking, then longest common subsequences.

A name is taken apart into first name, proper words by their sound, and line of business, by a vocabulary that is
learned from the names themselves; equal results form one spelling form, so copies cost nothing. The forms are indexed by suffixes of their words. A suffix alone is
far too common in a large table, so it is refined at once by the beginning, or the suffix, of another word of
the name. The forms of a block are compared in bulk, those of a large one chunk against chunk, so no two forms of
a block are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.llm.blocks import compare_blocks, in_chunks
from loomlink.llm.fields import Name, NameParser, Vocabulary, name_tokens
from loomlink.llm.lcs import TextColumn, lcs_pairs
from loomlink.llm.vocabulary import learn_vocabulary
from loomlink.session import cut

SUFFIX, BESIDE = 4, 3
ALIKE, CONTAINED = 0.78, 0.88
ALIKE_BESIDE, CONTAINED_BESIDE = 0.62, 0.72
TOO_COMMON = 400


def form_of(name: Name) -> str:
    """A parsed name as text: ``given|line|words``."""
    return f"{name.given}|{name.line}|{' '.join(name.words)}"


def suffix_keys(words: tuple[str, ...] | list[str], line: str = "") -> list[str]:
    """Index terms of a name: the suffix of a word with the beginning of another (or its own, for one word), two suffixes,
    and a suffix with the line of business and the first letter of another word."""
    n = len(words)
    if n == 1:
        return [words[0][-SUFFIX:] + ">" + words[0][:BESIDE]]
    keys = {w[-SUFFIX:] + ">" + v[:BESIDE] for i, w in enumerate(words) for j, v in enumerate(words) if i != j}
    ends = sorted(w[-BESIDE:] for w in words)
    keys.update(a + "<" + b for i, a in enumerate(ends) for b in ends[i + 1 :])
    if line:
        keys.update(f"{w[-SUFFIX:]}={v[0]}{line}" for i, w in enumerate(words) for j, v in enumerate(words) if i != j)
    if n >= 3:
        # Two words that a blank too many has split, or a whole name written as one.
        keys.add(words[-1][-SUFFIX:] + ">" + words[0][:BESIDE])
    return list(keys)


def _tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"gid": df["gid"], "country": df["country"], "tokens": [name_tokens(n) for n in df["name"]], "sp": df["sp"]})


def _forms_of(vocabulary: Vocabulary):
    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = NameParser(vocabulary)
        for df in batches:
            yield pd.DataFrame({"gid": df["gid"], "country": df["country"], "form": [form_of(parser.parse(t)) for t in df["tokens"]], "sp": df["sp"]})

    return forms


def _keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    for df in batches:
        rows, keys = [], []
        for i, (country, form) in enumerate(zip(df["country"], df["form"])):
            seed = country + ":"
            _, line, words = form.split("|")
            for k in suffix_keys(words.split(), line):
                rows.append(i)
                keys.append(digest(seed + k))
        at = np.array(rows, np.int64)
        yield pd.DataFrame({"block": np.array(keys, np.uint64).view(np.int64), "form_id": df["form_id"].to_numpy()[at], "form": df["form"].to_numpy()[at]})


def same_name(df: pd.DataFrame, left: np.ndarray, right: np.ndarray, alike: float = ALIKE, contained: float = CONTAINED) -> np.ndarray:
    """Whether the forms at ``left`` and ``right`` spell the name of one organisation."""
    if not len(left):
        return np.zeros(0, bool)
    parts = [f.split("|") for f in df["form"]]
    lines = pd.factorize(np.array([p[1] for p in parts], object))
    line, none = lines[0], np.flatnonzero(lines[1] == "")
    blank = int(none[0]) if len(none) else -1
    la, lb = line[left], line[right]
    ok = (la == lb) | (la == blank) | (lb == blank)
    given = np.array([p[0] for p in parts], object)
    ids, names = pd.factorize(given)
    table = np.array([[not x or not y or x == y or (min(len(x), len(y)) == 1 and x[0] == y[0]) for y in names] for x in names])
    ok &= table[ids[left], ids[right]]
    spots = np.flatnonzero(ok)
    words = [p[2].split() for p in parts]
    straight, ordered = TextColumn(["".join(w) for w in words]), TextColumn(["".join(sorted(w)) for w in words])
    count, size = np.array([len(w) for w in words]), straight.sizes
    out = np.zeros(len(left), bool)
    for x, y in ((straight, straight), (ordered, ordered), (straight, ordered), (ordered, straight)):
        if not len(spots):
            break
        a, b = left[spots], right[spots]
        common = lcs_pairs(x, a, b, y)
        short, long = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        # A whole name inside another: a word was left out, or the line of business is written on to it.
        inside = (common >= contained * short) & (short >= 10) & ((count[a] != count[b]) | (count[a] == 1)) & (long <= 2 * short)
        good = (2 * common >= alike * (short + long)) | inside
        out[spots[good]] = True
        spots = spots[~good]
    return out


def same_name_beside(df: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``same_name`` for forms that both spell a third one's name: they may differ by the slips of both."""
    return same_name(df, left, right, ALIKE_BESIDE, CONTAINED_BESIDE)


def link_beside(forms: DataFrame, links: DataFrame) -> DataFrame:
    """Further pairs ``a, b`` of forms that link to one and the same most frequent form.

    ``forms(form_id, country, form, n)`` holds the number ``n`` of rows of each form.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(forms.select(F.col("form_id").alias("a"), F.col("form_id").alias("b")))
    ranked = both.join(forms.select(F.col("form_id").alias("b"), "n"), "b")
    hub = cut(ranked.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"), "b"))["b"].alias("hub")))
    top = hub.select(F.col("a").alias("hub"), F.col("hub").alias("block"))
    blocks = forms.select(F.col("form_id").alias("a"), "form").join(hub, "a").join(top, "hub").select("block", F.col("a").alias("form_id"), "form")
    blocks = in_chunks(blocks, "form_id", TOO_COMMON)
    return blocks.repartition("block").sortWithinPartitions("block").mapInPandas(compare_blocks(same_name_beside, "block", "form_id"), "a bigint, b bigint")


def name_forms(df: DataFrame, key: str, name: str, country: str, spelling: str, nicknames: DataFrame | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``gid, form_id, form, country, sp`` of the rows with a proper word in their name; ``sp`` is a hash of the spelling."""
    rows = df.select(
        F.col(key).alias("gid"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.coalesce(F.col(country), F.lit("")).alias("country"), F.xxhash64(F.coalesce(F.col(spelling), F.lit(""))).alias("sp")
    ).where("gid is not null and name <> ''")
    tokens = cut(rows.mapInPandas(_tokens_of, "gid bigint, country string, tokens string, sp bigint"))
    vocabulary = vocabulary or learn_vocabulary(tokens, nicknames)
    parsed = tokens.mapInPandas(_forms_of(vocabulary), "gid bigint, country string, form string, sp bigint").where("not form like '%|'")
    return parsed.withColumn("form_id", F.xxhash64("country", "form"))


def link_forms(forms: DataFrame, too_common: int = TOO_COMMON) -> DataFrame:
    """``a, b`` (a < b): pairs of ``form_id`` of ``forms(form_id, country, form)``, each id once, that are one name."""
    keys = forms.select("country", "form", "form_id").mapInPandas(_keys_of, "block bigint, form_id bigint, form string")
    blocks = in_chunks(keys, "form_id", too_common).repartition("block").sortWithinPartitions("block")
    return blocks.mapInPandas(compare_blocks(same_name, "block", "form_id"), "a bigint, b bigint").distinct()


def link_names(
    df: DataFrame, key: str = "gid", name: str = "name", country: str = "country", spelling: str = "name_key", nicknames: DataFrame | None = None, vocabulary: Vocabulary | None = None
) -> DataFrame:
    """``gid_a, gid_b`` (a < b): rows of one country whose names are spellings of one organisation's name and whose ``spelling`` differs.

    Empty and NULL names, and names without a proper word, link to nothing; NULL countries are one country. Keys
    are unique bigints. Extra columns are not read. The ``vocabulary`` is learned from the names, with the help of
    ``nicknames(given, nick)``, unless it is given.
    """
    rows = cut(name_forms(df, key, name, country, spelling, nicknames, vocabulary))
    forms = rows.groupBy("form_id").agg(F.min("form").alias("form"), F.min("country").alias("country"), F.count(F.lit(1)).alias("n"))
    forms = cut(forms)
    links = cut(link_forms(forms))
    links = links.unionByName(link_beside(forms, links)).distinct()
    left = rows.select(F.col("form_id").alias("a"), F.col("gid").alias("ga"), F.col("sp").alias("sa"))
    right = rows.select(F.col("form_id").alias("b"), F.col("gid").alias("gb"), F.col("sp").alias("sb"))
    across = links.join(left, "a").join(right, "b")
    several = rows.groupBy("form_id").agg(F.min("sp").alias("lo"), F.max("sp").alias("hi")).where("lo <> hi").select(F.col("form_id").alias("a"))
    inside = left.join(several, "a", "left_semi").join(right, F.col("a") == F.col("b")).where("ga < gb")
    pairs = across.select("ga", "gb", "sa", "sb").unionByName(inside.select("ga", "gb", "sa", "sb")).where("sa <> sb")
    return pairs.select(F.least("ga", "gb").alias("gid_a"), F.greatest("ga", "gb").alias("gid_b"))
