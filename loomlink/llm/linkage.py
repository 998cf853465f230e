"""Records of several lists matched without a key, by a label model over heuristic votes.

Candidates come from name suffixes and from house numbers within towns. On each candidate several heuristic
functions vote: on the name, the line of business and the first name; on the number and street and on the town;
on how many listed places bear such a name or stand in such a building. A generative model with two hidden facts,
"same name" (N) and "same place" (A), learns without labels how often each vote is right, which votes on
one fact go together, and how the facts go together. The confidence of a pair is the posterior of both facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.llm.addresses import gazetteer
from loomlink.llm.blocks import across_chunks, pairs_within, whole_blocks
from loomlink.llm.fields import Gazetteer, NameParser, Vocabulary, name_tokens, parse_address
from loomlink.llm.lcs import TextColumn, lcs_pairs
from loomlink.llm.names import form_of, suffix_keys
from loomlink.llm.vocabulary import learn_vocabulary
from loomlink.session import cut

#: Votes and their numbers of values.
VOTES = {"name": 5, "line": 3, "given": 4, "number": 4, "street": 3, "town": 3}
CONTEXT = {"bearers": 3, "neighbours": 3}
_ANCHOR = 3.0
_ENTITY = "id bigint, listed boolean, country string, tokens string, number string, street string, kind string, town string"


def _parse(shared):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Gazetteer(*shared.value)
        known = {c.lower(): c for c in towns.names}
        for df in batches:
            out = []
            for i, listed, name, addr, country in zip(df["id"], df["listed"], df["name"], df["addr"], df["country"]):
                c = known.get(country.strip().lower())
                if c is None and not country.strip():
                    tried = [(a, k) for k in sorted(towns.names) if (a := parse_address(addr, k, towns)).town]
                    a, c = max(tried, key=lambda t: sum(map(bool, t[0])), default=(parse_address(addr, "", towns), ""))
                else:
                    c = c or country.strip()
                    a = parse_address(addr, c, towns)
                out.append((i, listed, c, name_tokens(name) if name else "", a.number, a.street, a.kind, a.town))
            yield pd.DataFrame(out, columns=["id", "listed", "country", "tokens", "number", "street", "kind", "town"])

    return parse


def _block_rows(vocabulary: Vocabulary):
    def block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest, parser = xxhash.xxh64_intdigest, NameParser(vocabulary)
        for df in batches:
            rows, keys, forms = [], [], []
            for i, (country, tokens, number, town) in enumerate(zip(df["country"], df["tokens"], df["number"], df["town"])):
                name = parser.parse(tokens)
                forms.append(form_of(name))
                if name.words:
                    # A record without a country, or with a wrong one, meets the others in its town only.
                    for k in suffix_keys(name.words, name.line):
                        rows.append(i)
                        keys.append(digest(f"{country}:{k}"))
                if number and town:
                    rows.append(i)
                    keys.append(digest(f"{town}#{number}"))
            at = np.array(rows, np.int64)
            out = df.assign(form=forms).iloc[at][["id", "listed", "form", "number", "street", "kind", "town"]].reset_index(drop=True)
            out.insert(0, "block", np.array(keys, np.uint64).view(np.int64))
            yield out

    return block_rows


def cast_votes(df: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """The votes on pairs of rows, each a small integer; 0 abstains."""
    parts = [f.split("|") for f in df["form"]]
    words = [p[2].split() for p in parts]
    straight, ordered = TextColumn(["".join(w) for w in words]), TextColumn(["".join(sorted(w)) for w in words])
    size, count = straight.sizes, np.array([len(w) for w in words])
    short, long = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    alike = np.zeros(len(left))
    inside = np.zeros(len(left))
    spots = np.flatnonzero(short > 0)
    for x, y in ((straight, straight), (ordered, ordered), (straight, ordered), (ordered, straight)):
        common = lcs_pairs(x, left[spots], right[spots], y)
        alike[spots] = np.maximum(alike[spots], 2 * common / (short + long)[spots])
        inside[spots] = np.maximum(inside[spots], common / short[spots])
        spots = spots[alike[spots] < 0.97]
    part = (short >= 10) & ((count[left] != count[right]) | (count[left] == 1)) & (long <= 2 * short)
    name = np.select([short == 0, alike >= 0.97, (alike >= 0.78) | part & (inside >= 0.88), (alike >= 0.62) | part & (inside >= 0.72)], [0, 1, 2, 3], 4)

    def known(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, names = pd.factorize(np.array(values, object))
        return ids, np.array([bool(n) for n in names])[ids]

    line, has = known([p[1] for p in parts])
    line_vote = np.where(has[left] & has[right], np.where(line[left] == line[right], 1, 2), 0)
    ids, names = pd.factorize(np.array([p[0] for p in parts], object))
    table = np.array([[0 if not x and not y else 2 if not x or not y else 1 if x == y or (min(len(x), len(y)) == 1 and x[0] == y[0]) else 3 for y in names] for x in names])
    given_vote = table[ids[left], ids[right]]
    number, has = known(df["number"].tolist())
    number_vote = np.where(has[left] & has[right], np.where(number[left] == number[right], 1, 3), 0)
    # One digit that differs, of equally many: a slip.
    digits = df["number"].to_numpy(object).astype("U") if len(df) else np.zeros(0, "U1")
    width = max(1, digits.dtype.itemsize // 4)
    cells, size = np.ascontiguousarray(digits).view(np.uint32).reshape(len(digits), width), np.char.str_len(digits)
    differ = np.flatnonzero(number_vote == 3)
    a, b = left[differ], right[differ]
    number_vote[differ[(size[a] == size[b]) & ((cells[a] != cells[b]).sum(1) == 1)]] = 2
    streets = TextColumn(df["street"].tolist())
    s, t = streets.sizes[left], streets.sizes[right]
    common = lcs_pairs(streets, left, right)
    least, most = np.minimum(s, t), np.maximum(s, t)
    same = (2 * common >= 0.7 * (least + most)) | (least >= 4) & (common >= least - (least >= 7))
    kind, has = known(df["kind"].tolist())
    same &= ~(has[left] & has[right] & (kind[left] != kind[right]))
    street_vote = np.where(least == 0, 0, np.where(same, 1, 2))
    town, has = known(df["town"].tolist())
    town_vote = np.where(has[left] & has[right], np.where(town[left] == town[right], 1, 2), 0)
    return {"name": name, "line": line_vote, "given": given_vote, "number": number_vote, "street": street_vote, "town": town_vote}


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in whole_blocks(batches, "block"):
        k = df["block"].to_numpy()
        starts = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
        sizes = np.diff(starts, append=len(k))
        load = np.cumsum(sizes * (sizes - 1) // 2) // 400_000
        ids, listed = df["id"].to_numpy(), df["listed"].to_numpy()
        for g in np.unique(load):
            m = np.flatnonzero(load == g)
            left, right = pairs_within(sizes[m])
            left, right = left + starts[m[0]], right + starts[m[0]]
            cross = listed[left] != listed[right]
            left, right = left[cross], right[cross]
            swap = ~listed[left]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            if not len(left):
                continue
            order = np.lexsort((ids[right], ids[left]))
            a, b = ids[left[order]], ids[right[order]]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            left, right = left[order[fresh]], right[order[fresh]]
            v = cast_votes(df, left, right)
            # Without a likeness of the names only the very same address makes a candidate.
            keep = np.isin(v["name"], (1, 2, 3)) | (v["number"] == 1) & (v["street"] == 1) & (v["town"] == 1)
            yield pd.DataFrame({"s1": ids[left][keep], "rid": ids[right][keep], **{n: x[keep].astype(np.int32) for n, x in v.items()}})


def candidate_votes(entities: DataFrame, vocabulary: Vocabulary = Vocabulary(), too_common: int = 400) -> DataFrame:
    """``s1, rid`` and a column per vote, for every pair of a listed and another entity that meet in a block.

    Blocks of more than ``too_common`` rows are compared in whole, a chunk of their listed entities against a chunk of the others at a time.
    """
    rows = entities.mapInPandas(_block_rows(vocabulary), "block bigint, id bigint, listed boolean, form string, number string, street string, kind string, town string")
    schema = "s1 bigint, rid bigint, " + ", ".join(f"{v} int" for v in VOTES)
    blocks = across_chunks(rows, "id", "listed", too_common)
    return blocks.repartition("block").sortWithinPartitions("block").mapInPandas(_candidates, schema).distinct()


def add_context(votes: DataFrame) -> DataFrame:
    """Votes on how many listed entities of a record's candidates bear its name, and how many share its address: 0 none, 1 one, 2 more."""
    bears = F.col("name").isin(1, 2, 3) & (F.col("line") != 2) & (F.col("given") != 3)
    there = (F.col("number") == 1) & (F.col("street") == 1) & (F.col("town") == 1)
    per = votes.groupBy("rid").agg(F.least(F.lit(2), F.count_if(bears)).cast("int").alias("bearers"), F.least(F.lit(2), F.count_if(there)).cast("int").alias("neighbours"))
    return votes.join(per, "rid")


#: The fact that each vote speaks of, and from which conditional mutual information (nats) on two votes on one fact go together.
FACTS = {"N": ("name", "line", "given"), "A": ("number", "street", "town")}
TOGETHER = 0.02


def votes_that_go_together(votes: dict[str, np.ndarray], n: np.ndarray, joint: np.ndarray) -> list[tuple[str, tuple[str, ...]]]:
    """Groups of votes on one fact that depend on each other though the fact is known: ``(fact, votes)``, learned from the cases.

    ``joint`` is the chance of each state of the facts (N, A) for the vote patterns, which stand for ``n`` cases each.
    """
    out = []
    for fact, names in FACTS.items():
        true = joint[:, 2] + joint[:, 3] if fact == "N" else joint[:, 1] + joint[:, 3]
        group = {v: {v} for v in names}
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                mutual = 0.0
                for weight in (n * true, n * (1 - true)):
                    table = np.zeros((VOTES[x], VOTES[y]))
                    np.add.at(table, (votes[x], votes[y]), weight)
                    p = table / max(weight.sum(), 1e-300)
                    apart = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                    some = p > 0
                    mutual += weight.sum() / n.sum() * float((p[some] * np.log(p[some] / apart[some])).sum())
                if mutual >= TOGETHER and group[x] is not group[y]:
                    both = group[x] | group[y]
                    for v in both:
                        group[v] = both
        out += [(fact, g) for g in sorted({tuple(v for v in names if v in g) for g in group.values()})]
    return out


def fit_label_model(patterns: pd.DataFrame, rounds: int = 60) -> np.ndarray:
    """Posterior of (N, A) = (1, 1) for each row of distinct vote patterns with their counts ``n``.

    Expectation-maximisation; the start is a plain reading of the votes. The chances that this start gives count as
    ``_ANCHOR`` further cases for each case, so that the cases can correct them but not turn the facts' meaning.
    Votes on one fact that are found to depend on each other have a joint table, the others one each.
    """
    if not len(patterns):
        return np.zeros(0)
    p = {c: patterns[c].to_numpy() for c in (*VOTES, *CONTEXT)}
    n = patterns["n"].to_numpy().astype(float)
    bad = (p["line"] == 2) | (p["given"] == 3) | (p["name"] == 4)
    said_n = np.select([bad, np.isin(p["name"], (1, 2)), p["name"] == 3], [0.005, 0.995, 0.6], 0.5)
    wrong = (p["number"] == 3) | (p["street"] == 2) | (p["town"] == 2)
    said_a = np.select([wrong, (p["number"] == 1) & (p["street"] == 1), (p["number"] == 2) | (p["street"] == 1)], [0.005, 0.995, 0.7], 0.5)
    joint = np.stack([(1 - said_n) * (1 - said_a), (1 - said_n) * said_a, said_n * (1 - said_a), said_n * said_a], 1)
    # Code of the votes that go together, number of codes, the fact they speak of, whether they say anything, and whether it
    # is asked for: how many bear the name only matters without an address, how many stand there only without a name.
    every = np.ones(len(n), bool)
    groups = []
    for fact, names in votes_that_go_together(p, n, joint):
        code, k, speaks = np.zeros(len(n), np.int64), 1, np.zeros(len(n), bool)
        for v in names:
            code, k = code * VOTES[v] + p[v], k * VOTES[v]
            # Whether there are words of a name decides whether the rest of it can speak.
            speaks |= p[v] > 0 if fact == "A" else p["name"] > 0
        groups.append((code, k, fact, speaks, every))
    groups += [(p["bearers"], 3, "NA", p["name"] > 0, p["number"] == 0), (p["neighbours"], 3, "NA", every, p["name"] == 0)]
    state = {"N": np.array([0, 0, 1, 1]), "A": np.array([0, 1, 0, 1]), "NA": np.array([0, 1, 2, 3])}
    anchor: list[np.ndarray] = []
    for _ in range(rounds):
        weight = joint * n[:, None]
        prior = weight.sum(0) + 1
        log = np.log(prior / prior.sum())[None, :].repeat(len(n), 0)
        for g, (code, k, on, speaks, asked) in enumerate(groups):
            table = np.full((state[on].max() + 1, k), 0.5)
            for s in range(4):
                np.add.at(table[state[on][s]], code[speaks], weight[speaks, s])
            if len(anchor) <= g:
                anchor.append(_ANCHOR * table)
            else:
                table += anchor[g]
            table /= table.sum(1, keepdims=True)
            log += np.where((speaks & asked)[:, None], np.log(table[state[on]][:, code]).T, 0.0)
        log -= log.max(1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(1, keepdims=True)
        if np.abs(new - joint).max() < 1e-6:
            joint = new
            break
        joint = new
    return joint[:, 3]


def entities_of(records: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entities, ids)``: one parsed row per ``entity_id``, from its fullest delivery (ties by the smaller ``row_id``)."""
    full = lambda c: F.when(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "null"), F.lit("")).otherwise(F.col(c))
    rows = records.where("entity_id is not null and row_id is not null and src is not null").select("row_id", F.trim("entity_id").alias("entity_id"), "src", full("name").alias("name"), full("addr").alias("addr"), F.coalesce("country", F.lit("")).alias("country"))
    best = F.max_by(F.struct("row_id", "src", "name", "addr", "country"), F.struct(F.col("addr") != "", F.col("name") != "", F.trim("country") != "", -F.col("row_id")))
    chosen = rows.groupBy("entity_id").agg(best.alias("r")).select("entity_id", "r.*")
    chosen = cut(chosen)
    listed = chosen.select(F.col("row_id").alias("id"), (F.col("src") == 1).alias("listed"), "name", "addr", "country").repartition(F.col("id"))
    return cut(listed.mapInPandas(_parse(gazetteer(places, chosen)), _ENTITY)), chosen.select(F.col("row_id").alias("id"), "entity_id")


def link_records(records: DataFrame, places: DataFrame, least: float = 0.5, nicknames: DataFrame | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``s1, rid, confidence``: for every entity of ``src`` 2 and 3 the listed entity (``src`` 1) at the same place, if the confidence reaches ``least``.

    An entity has at most one, ties by likeness of the name, then by the smaller id. Read are ``row_id, entity_id,
    name, addr, country, src``; NULL, blank and "null" texts abstain; rows without an id are left out; repeated
    deliveries count as one entity. An entity with neither name nor address matches nothing. The ``vocabulary`` of names is
    learned from them, with the help of ``nicknames(given, nick)``, unless it is given.
    """
    entities, ids = entities_of(records, places)
    vocabulary = vocabulary or learn_vocabulary(entities.select("tokens"), nicknames)
    votes = cut(add_context(candidate_votes(entities, vocabulary)))
    names = [*VOTES, *CONTEXT]
    # At most the product of the numbers of values, whatever the data's size.
    patterns = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).toPandas()
    patterns["p"] = fit_label_model(patterns).round(6)
    spark = records.sparkSession
    if not len(patterns):
        return spark.createDataFrame([], "s1 string, rid string, confidence double")
    posterior = spark.createDataFrame(patterns[[*names, "p"]], ", ".join(f"{v} int" for v in names) + ", p double")
    scored = votes.join(F.broadcast(posterior), names).where(F.col("p") >= least)
    best = scored.groupBy("rid").agg(F.max_by("s1", F.struct("p", -F.col("name"), -F.col("s1"))).alias("s1"), F.max("p").alias("confidence"))
    left, right = ids.select(F.col("id").alias("s1"), F.col("entity_id").alias("e1")), ids.select(F.col("id").alias("rid"), F.col("entity_id").alias("e2"))
    return best.join(left, "s1").join(right, "rid").select(F.col("e1").alias("s1"), F.col("e2").alias("rid"), "confidence")
