"""One building, many wordings of its address: a containment join on weighted tokens.

An address is taken apart into tokens: house number within the town, street, kind of street; equal results are one
form. A token weighs the more the rarer it is among all forms (logarithm of the forms over those that bear it). Missing
parts, such as the kind, only make an address less full. The rarest token that all wordings of a building share letter
for letter is the number within the town, as the spelling of a street varies; every form is indexed under it, and the
forms under one token are compared, those of a large one chunk against chunk. Of two forms the one of the greater weight
is the fuller; the weight of the other's tokens that it contains decides, a street counting in the share of its longest
common subsequence. Kinds that are both said and differ contradict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.llm.blocks import compare_blocks, in_chunks
from loomlink.llm.fields import Gazetteer, marked_places, parse_address
from loomlink.llm.lcs import TextColumn, lcs_pairs
from loomlink.session import cut

HELD = 0.85
TOO_COMMON = 1000
_MOST_PLACES = 1_000_000
#: A landmark follows at least so many of the words that lead to one, and this share of them.
LEAST_MARKED, MARKED_SHARE = 10, 0.005


def learn_landmarks(addresses: DataFrame) -> tuple[str, ...]:
    """What addresses name as landmarks: the word, or two words, that often follow "near", "behind" and the like in ``addresses(addr)``."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame([p for a in df["addr"] for p in marked_places(a)], columns=["first", "second"], dtype=object)

    marked = addresses.where(F.col("addr").rlike(r"(?i)\b(?:near|nr|at|opp|opposite|behind|beside|next|pr.s|derri.re|c.t.|face)\b"))
    counts = cut(marked.select("addr").mapInPandas(places, "first string, second string").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")))
    per = counts.groupBy("first").agg(F.sum("n").alias("whole"))
    whole = per.agg(F.sum("whole")).first()[0] or 0
    least = max(LEAST_MARKED, MARKED_SHARE * whole)
    # No more than 1 / MARKED_SHARE words can each follow that share.
    first = dict(map(tuple, per.where(F.col("whole") >= least).collect()))
    out = set()
    for a, b, n in counts.where(F.col("n") >= least).collect():
        if b and n >= 0.5 * first[a]:
            out.add(f"{a} {b}")
    return tuple(sorted(out | {a for a in first if not any(p.startswith(a + " ") for p in out)}))


def gazetteer(places: DataFrame, addresses: DataFrame | None = None):
    """A broadcast of the towns, once their number is found to be within bounds, and of the landmarks that ``addresses(addr)`` name."""
    n = places.count()
    if n > _MOST_PLACES:
        raise ValueError(f"{n} places are too many for every task to hold")
    rows = [tuple(r) for r in places.select("country", "city", "state", "state_code", "pc_prefix").where("country is not null and city is not null").collect()]
    return places.sparkSession.sparkContext.broadcast((sorted(rows, key=str), learn_landmarks(addresses) if addresses is not None else ()))


def _parse(shared):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Gazetteer(*shared.value)
        for df in batches:
            got = [parse_address(a, c, towns) for a, c in zip(df["addr"], df["country"])]
            yield pd.DataFrame(
                {
                    "gid": df["gid"], "number": [g.number for g in got], "street": [g.street for g in got], "kind": [g.kind for g in got],
                    "town": [g.town for g in got], "spelling": df["spelling"],
                }
            )

    return parse


def street_share(column: TextColumn, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How much of one street's name the other holds, 0 to 1: their ratio, or a little less than a containment."""
    common = lcs_pairs(column, left, right)
    short, long = np.minimum(column.sizes[left], column.sizes[right]), np.maximum(column.sizes[left], column.sizes[right])
    inside = np.where((short >= 4) & (common >= short - (short >= 7)), common / np.maximum(short, 1), 0.0)
    return np.maximum(2 * common / np.maximum(short + long, 1), inside * 0.9)


def same_building(df: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether of the forms at ``left`` and ``right`` the fuller contains the other well enough and contradicts it in nothing.

    The frame has the forms' ``town, number, street, kind`` and the weights ``w_number, w_street, w_kind``.
    """
    if not len(left):
        return np.zeros(0, bool)
    town, number, kind = (pd.factorize(df[c])[0] for c in ("town", "number", "kind"))
    said = (df["kind"] != "").to_numpy()
    same_kind = kind[left] == kind[right]
    spots = np.flatnonzero((town[left] == town[right]) & (number[left] == number[right]) & (same_kind | ~said[left] | ~said[right]))
    out = np.zeros(len(left), bool)
    if not len(spots):
        return out
    w_number, w_street, w_kind = (df[c].to_numpy() for c in ("w_number", "w_street", "w_kind"))
    whole = w_number + w_street + w_kind
    a, b = left[spots], right[spots]
    less = np.where(whole[a] <= whole[b], a, b)
    held = w_number[less] + w_street[less] * street_share(TextColumn(df["street"].tolist()), a, b) + np.where(same_kind[spots], w_kind[less], 0.0)
    out[spots] = held >= HELD * whole[less]
    return out


def building_forms(df: DataFrame, places: DataFrame, key: str, addr: str, country: str, spelling: str) -> DataFrame:
    """``gid, number, street, kind, town, sp, form_id`` of the rows whose address names all three."""
    rows = df.select(
        F.col(key).alias("gid"), F.coalesce(F.col(addr), F.lit("")).alias("addr"), F.coalesce(F.col(country), F.lit("")).alias("country"), F.coalesce(F.col(spelling), F.lit("")).alias("spelling")
    ).where("gid is not null and addr <> ''")
    schema = "gid bigint, number string, street string, kind string, town string, spelling string"
    parsed = rows.mapInPandas(_parse(gazetteer(places, rows)), schema).where("number <> '' and street <> '' and town <> ''")
    return parsed.select("gid", "number", "street", "kind", "town", F.xxhash64("spelling").alias("sp"), F.xxhash64("town", "number", "street", "kind").alias("form_id"))


def weighed(forms: DataFrame) -> DataFrame:
    """``forms`` with ``w_number, w_street, w_kind``: ln of the number of forms over those with the token, plus a little; 0 for a kind not said."""
    whole = forms.agg(F.count(F.lit(1)).alias("whole"))  # one row
    for name, on in (("w_number", ["town", "number"]), ("w_street", ["town", "street"]), ("w_kind", ["kind"])):
        weight = F.log(F.col("whole") / F.col("n")) + 0.01
        per = forms.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole)).select(*on, (weight if name != "w_kind" else F.when(F.col("kind") != "", weight).otherwise(0.0)).alias(name))
        # There are no more kinds of street than the parser knows.
        forms = forms.join(F.broadcast(per) if name == "w_kind" else per, on)
    return forms


def link_buildings(forms: DataFrame) -> DataFrame:
    """``a, b`` (a < b): pairs of ``form_id`` of ``forms(form_id, number, street, kind, town)``, each id once, that denote one building."""
    columns = ["form_id", "number", "street", "kind", "town", "w_number", "w_street", "w_kind"]
    blocks = cut(weighed(forms.select(*columns[:5])).select(F.xxhash64("town", "number").alias("block"), *columns))
    blocks = in_chunks(blocks, "form_id", TOO_COMMON)
    found = blocks.repartition("block").sortWithinPartitions("block").mapInPandas(compare_blocks(same_building, "block", "form_id"), "a bigint, b bigint")
    return found.distinct()


def link_addresses(df: DataFrame, places: DataFrame, key: str = "gid", addr: str = "addr", country: str = "country", spelling: str = "addr_roman") -> DataFrame:
    """``gid_a, gid_b`` (a < b): rows whose addresses denote one building and whose ``spelling`` differs.

    An address without house number, street or town links to nothing, nor do empty and NULL ones. Leading zeros,
    flats, landmarks, states and box numbers don't count. Keys are unique bigints; extra columns are not read.
    """
    rows = cut(building_forms(df, places, key, addr, country, spelling))
    forms = rows.groupBy("form_id").agg(*(F.min(c).alias(c) for c in ("number", "street", "kind", "town")))
    links = link_buildings(forms)
    left = rows.select(F.col("form_id").alias("a"), F.col("gid").alias("ga"), F.col("sp").alias("sa"))
    right = rows.select(F.col("form_id").alias("b"), F.col("gid").alias("gb"), F.col("sp").alias("sb"))
    across = links.join(left, "a").join(right, "b")
    several = rows.groupBy("form_id").agg(F.min("sp").alias("lo"), F.max("sp").alias("hi")).where("lo <> hi").select(F.col("form_id").alias("a"))
    inside = left.join(several, "a", "left_semi").join(right, F.col("a") == F.col("b")).where("ga < gb")
    pairs = across.select("ga", "gb", "sa", "sb").unionByName(inside.select("ga", "gb", "sa", "sb")).where("sa <> sb")
    return pairs.select(F.least("ga", "gb").alias("gid_a"), F.greatest("ga", "gb").alias("gid_b"))
