"""The generic words of names, learned from the names themselves: lines of business, first names, and their short forms.

A generic word stands beside very many different words; a line of business closes most of the names that hold it, a first
name opens them. A short form is found by what it stands with: nearly every pair of proper words that has it has its
full form too, while two different lines or first names seldom share their proper words. Every row is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.llm.fields import Vocabulary, fold, plain_text
from loomlink.session import cut

#: A generic word has so many different neighbours, and at least this share of the number of names.
LEAST_NEIGHBOURS, NEIGHBOURS_A_NAME = 40, 0.0004
#: In so much of its occurrences it is the last word, or the first.
PLACED = 0.75
#: So much of a short form's proper words stand with the full form too.
TOGETHER = 0.5
_MOST_WORDS, _MOST_NICKNAMES = 100_000, 1_000_000


def generic_words(words: DataFrame, names: int) -> tuple[set[str], set[str]]:
    """Lines and first names among ``words(words)``, one array of different words for each of the ``names`` names.

    What comes to the driver is bounded: no more words can each stand in the least number of names than there are
    places for words divided by that number.
    """
    least = max(LEAST_NEIGHBOURS, NEIGHBOURS_A_NAME * names)
    w = F.col("words")
    place = F.transform(w, lambda x, i: F.struct(x.alias("w"), (i == 0).cast("int").alias("first"), (i == F.size(w) - 1).cast("int").alias("last"), F.get(w, i - 1).alias("before"), F.get(w, i + 1).alias("after")))
    places = words.where(F.size("words") > 1).select(F.explode(place).alias("x")).select("x.*")
    counts = places.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("first"), F.sum("last").alias("last"))
    # A word has at most two neighbours in a name.
    placed = counts.where((2 * F.col("n") >= least) & (F.greatest("first", "last") >= PLACED * F.col("n"))).select("w", F.col("last") > F.col("first"))
    kinds = dict(map(tuple, placed.limit(_MOST_WORDS + 1).collect()))
    if len(kinds) > _MOST_WORDS:
        raise ValueError("too many generic words for every task to hold")
    if not kinds:
        return set(), set()
    met = places.where(F.col("w").isin(*sorted(kinds)))
    beside = met.select("w", F.explode(F.array("before", "after")).alias("v")).where("v is not null").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"] for r in beside.where(F.col("n") >= least).select("w").collect()}
    return {x for x in found if kinds[x]}, {x for x in found if not kinds[x]}


def full_forms(words: DataFrame, lines: set[str], given: set[str]) -> dict[str, str]:
    """The more frequent word that a generic word stands for, if there is one."""
    if not lines and not given:
        return {}
    generic = sorted(lines | given)
    own, proper = F.filter("words", lambda x: x.isin(*generic)), F.filter("words", lambda x: ~x.isin(*generic))
    split = words.select(proper.alias("proper"), own.alias("own")).where("size(proper) >= 2 and size(own) > 0")
    stands = split.select(F.xxhash64(F.array_join(F.array_sort("proper"), " ")).alias("base"), F.explode("own").alias("w"))
    rows = cut(stands.groupBy("base", "w").agg(F.count(F.lit(1)).alias("n")))
    # A set holds generic words only, so it is no larger than the vocabulary.
    sets = rows.groupBy("base").agg(F.collect_list("w").alias("ws"), F.count(F.lit(1)).alias("k")).where("k > 1").select("ws")
    pairs = cut(sets.select("ws", F.explode("ws").alias("a")).select("a", F.explode("ws").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    whole = pairs.where("a = b").select("a", F.col("n").alias("whole"))
    often = {r["w"]: r["n"] for r in rows.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    close = pairs.where("a <> b").join(F.broadcast(whole), "a").where(F.col("n") >= TOGETHER * F.col("whole")).select("a", "b", "n").collect()
    out: dict[str, str] = {}
    for a, b, n in sorted(close, key=lambda r: (r[0], -r[2], r[1])):
        if a not in out and (a in lines) == (b in lines) and (often[b], b) > (often[a], a):
            out[a] = b
    return out


def learn_vocabulary(tokens: DataFrame, nicknames: DataFrame | None = None) -> Vocabulary:
    """The vocabulary of ``tokens(tokens)``, texts as ``fields.name_tokens`` writes them; ``nicknames(given, nick)`` adds to what is learned.

    Names written as one word, as in addresses of the web, are left out. Without enough names nothing is learned.
    """
    words = tokens.where("not startswith(tokens, '@')").select(F.array_distinct(F.filter(F.split("tokens", " "), lambda t: F.char_length(t) > 1)).alias("words"))
    words = cut(words.where("size(words) > 0"))
    lines, given = generic_words(words, words.count())
    full = full_forms(words, lines, given)

    def end(x: str) -> str:
        seen = {x}
        while x in full and full[x] not in seen:
            x = full[x]
            seen.add(x)
        return x

    names = {x: end(x) for x in given}
    if nicknames is not None:
        rows = nicknames.where("given is not null and nick is not null").select("given", "nick").limit(_MOST_NICKNAMES + 1).collect()
        if len(rows) > _MOST_NICKNAMES:
            raise ValueError("too many nicknames for every task to hold")
        for g, n in sorted((fold(plain_text(r["given"])), fold(plain_text(r["nick"]))) for r in rows):
            names.setdefault(g, g)
            names.setdefault(n, names[g])
    return Vocabulary({x: end(x) for x in lines}, names)
