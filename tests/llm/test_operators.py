"""The training-data operators against brute force, and their odd inputs."""

import math
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomlink.llm import addresses, leakage, linkage, names, packing, spans, splits, topn_runs, unicode_forms
from loomlink.llm.blocks import across_chunks, in_chunks
from loomlink.llm.fields import Gazetteer, Vocabulary, name_tokens, parse_address, parse_name
from loomlink.llm.vocabulary import learn_vocabulary
from loomlink.llm.fm_index import FMIndex
from loomlink.llm.lcs import TextColumn, lcs, lcs_pairs

PLACES = [("US", "Saint Vibrabon", "North Velland", "NV", "792"), ("US", "Brukrejes", "Idaluna", "ID", "412"), ("India", "Boviles", "Uttar Malvi", "UM", "441"), ("France", "Trufivis", "Basse-Lirne", "BL", "403")]
PLACE_COLUMNS = "country string, city string, state string, state_code string, pc_prefix string"


LINES = {"manufakturing": "mfg manuf", "fuds": "fds", "dairi": "", "motors": "", "sons": ""}
WORDS = Vocabulary({x: k for k, v in LINES.items() for x in [k, *v.split()]}, {"robert": "robert", "bob": "robert", "viliam": "viliam"})


def places(spark):
    return spark.createDataFrame(PLACES, PLACE_COLUMNS)


# Longest common subsequences


def test_bulk_lcs_equals_single():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(20))) for _ in range(200)] + ["x" * 90, "xy" * 60, "é" * 5, ""]
    a, b = np.array([rnd.randrange(len(texts)) for _ in range(3000)]), np.array([rnd.randrange(len(texts)) for _ in range(3000)])
    want = [lcs(texts[i], texts[j]) for i, j in zip(a, b)]
    assert lcs_pairs(TextColumn(texts), a, b).tolist() == want
    assert lcs("abcde", "xbxdx") == 2 and lcs("", "a") == 0


# 1: names


def test_parse_name():
    assert parse_name("Sazajas Drameegir Pvt. Ltd.") == parse_name("SAZAJAS DRAMIGIR")
    assert parse_name("www.trimoka-vizalis.test").words == ("trimoka", "vijalis")
    assert parse_name("Bob Aber Cofen & Sons", WORDS).given == "robert" and parse_name("R. Aber Cofen and Sons Ltd", WORDS).given == "r"
    assert parse_name("Trimoka Vizalis Mfg", WORDS).line == parse_name("Trimoka Vizalis Manufcturing", WORDS).line == "manufakturing"
    assert parse_name("Dеnape‎s Foods", WORDS).words == ("denapes",)
    assert parse_name("").words == () and parse_name("Ltd").words == ()
    assert parse_name("ab " * 5000).words == ("ab",)


def test_vocabulary_is_learned(spark):
    """Lines, first names and their short forms from what they stand with; nothing from a few names."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bdfgjklmnprstv") + rnd.choice("aeiou") for _ in range(4))
    rows = []
    for k in range(900):
        a, b, line = word(), word(), ("Bakery", "Motors", "Dairy")[k % 3]
        rows += [f"{a} {b} {line} Ltd", f"{a.upper()} {b} {line if k % 2 else {'Bakery': 'Bkry', 'Motors': 'Mtrs', 'Dairy': 'Dry'}[line]}"]
        given = ("Robert", "Ann")[k % 2]
        rows += [f"{given} {b} {a} Inc", f"{'Rob' if given == 'Robert' and k % 4 else given} {b} {a}"]
    tokens = spark.createDataFrame([(name_tokens(n),) for n in rows], "tokens string")
    nicknames = spark.createDataFrame([("Robert", "Bob"), (None, "x"), ("Ann", None)], "given string, nick string")
    v = learn_vocabulary(tokens, nicknames)
    assert v.lines == {"bakeri": "bakeri", "bkri": "bakeri", "motors": "motors", "mtrs": "motors", "dairi": "dairi", "dri": "dairi"}
    assert v.given == {"robert": "robert", "rob": "robert", "bob": "robert", "an": "an"}
    assert learn_vocabulary(tokens.limit(10)) == Vocabulary({}, {}) and learn_vocabulary(tokens.limit(0)) == Vocabulary({}, {})


def test_link_names(spark):
    rows = [
        (1, "Trimoka Vizalis Manufacturing Limited", "US", "a"), (2, "TRIMOKA VIZALLIS MFG", "US", "b"), (3, "Trimoka Vizalis Foods", "US", "c"), (4, "Vizalis Trimoka Manuf. Ltd", "US", "d"),
        (5, "Trimoka Vizalis Manufacturing", "France", "e"), (6, "", "US", "f"), (7, None, None, None), (8, "Bob Aber Cofen & Sons", "US", "g"), (9, "William Aber Cofen and Sons", "US", "h"),
        (10, "Robert Aber Cofen & Sons Inc", "US", "i"), (11, "Trimoka Vizalis Manufacturing Limited", "US", "a"), (12, "तरिमोका विज़ालिस Limited", None, "x"), (13, "y" * 20000, "US", "y"),
    ]
    df = spark.createDataFrame(rows, "gid bigint, name string, country string, name_key string").withColumn("form", F.lit(1)).withColumn("block", F.lit("q"))
    got = sorted(map(tuple, names.link_names(df, vocabulary=WORDS).collect()))
    assert got == [(1, 2), (1, 4), (2, 4), (2, 11), (4, 11), (8, 10)]
    assert names.link_names(df.limit(0)).count() == 0
    forms = names.name_forms(df, "gid", "name", "country", "name_key", vocabulary=WORDS).select("form_id", "form", "country").distinct()
    calm = sorted(map(tuple, names.link_forms(forms).collect()))
    assert sorted(map(tuple, names.link_forms(forms, too_common=2).collect())) == calm


# 2: top N


def test_top_n(spark):
    rnd = random.Random(2)
    rows = list({(rnd.choice([1, 1, 1, 2, 3, 4, 5, 6]), rnd.randrange(500)): None for _ in range(1500)})
    rows = [(g, i, rnd.choice([0.1, 0.5, 0.5, 0.9, None, float("nan")])) for g, i in rows] + [(None, 1, 0.5), (1, None, 0.5)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, s double").withColumn("bucket", F.lit("x")).repartition(5)
    for n in (1, 5, 1000):
        got = sorted((r["g"], r["place"], r["i"]) for r in topn_runs.top_n_per_group(df, "g", "i", "s", n, buckets=3).collect())
        want = []
        for g in range(1, 7):
            best = sorted((-s, i) for x, i, s in rows if x == g and i is not None and s is not None and not math.isnan(s))[:n]
            want += [(g, k, i) for k, (_, i) in enumerate(best, 1)]
        assert got == want
    assert topn_runs.top_n_per_group(df.limit(0), "g", "i", "s", 5).count() == 0
    with pytest.raises(ValueError):
        topn_runs.top_n_per_group(df, "g", "i", "s", 0)


def test_loser_tree_merges_any_number_of_runs():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = []
        for r in range(k):
            rows = sorted({(rnd.randrange(5), -rnd.randrange(4), rnd.randrange(1000) * 17 + r) for _ in range(rnd.randrange(40))})
            runs.append((np.array([x[0] for x in rows], np.int64), -np.array([x[1] for x in rows], float), np.array([x[2] for x in rows], np.int64)))
        rows = sorted((g, -s, i) for run in runs for g, s, i in zip(*(c.tolist() for c in run)))
        want, seen = [], {}
        for g, s, i in rows:
            seen[g] = seen.get(g, 0) + 1
            if seen[g] <= 3:
                want.append((g, i, -s, seen[g]))
        assert list(topn_runs.merge_runs(runs, 3)) == want


def test_merge_of_runs_that_come_in_chunks():
    """Chunks in the order of their first keys: the rows come out the same, and only begun chunks are held."""
    rnd = random.Random(33)
    for n, size in ((1, 1), (3, 2), (5, 7)):
        runs = [sorted({(rnd.randrange(40), -rnd.randrange(4) / 2, rnd.randrange(1000) * 70 + r) for _ in range(rnd.randrange(60))}) for r in range(70)]
        chunks = sorted((run[at], r, run[at : at + size]) for r, run in enumerate(runs) for at in range(0, len(run), size))
        merger, got, held = topn_runs.RunMerger(n), [], 0
        for first, r, rows in chunks:
            got += merger.until((1, *first))
            merger.add(r, np.array([x[0] for x in rows], np.int64), -np.array([x[1] for x in rows], float), np.array([x[2] for x in rows], np.int64))
            held = max(held, max(len(x.chunks) for x in merger.runs.values()))
        got += merger.until()
        want, seen = [], {}
        for g, s, i in sorted(x for run in runs for x in run):
            seen[g] = seen.get(g, 0) + 1
            if seen[g] <= n:
                want.append((g, i, -s, seen[g]))
        assert got == want and held <= 1


# 3: addresses


def test_parse_address():
    g = Gazetteer(PLACES, ("clock tower",))
    a = parse_address("1948 Shetetru Street, Saint Vibrabon, NV 79276", "US", g)
    assert (a.number, a.street, a.kind, a.town) == ("1948", "shetetru", "street", "US/saintvibrabon")
    for other in ("01948 SHETETRU ST., ST. VIBRABON, NORTH VELLAND", "No. 1948, Shetetru Str; 79276-2932; NV", "Suite 7, 1948 Shetetru Street, Near Clock Tower, Saint Vibrabon"):
        b = parse_address(other, "US", g)
        assert (b.number, b.street, b.kind, b.town) == (a.number, a.street, a.kind, a.town), other
    assert parse_address("10, bd  Ｔｉｄｒｕｂｒｏ 40399 Triufivis", "France", g)[:4] == ("10", "tidrubro", "boulevard", "France/trufivis")
    assert parse_address("PO Box 12, Boviles", "India", g).number == ""
    assert parse_address("", "US", g) == ("", "", "", "", "") and parse_address("x" * 30000, "", g).town == ""


def test_landmarks_are_learned(spark):
    rows = [(f"{i} Hill Road, Near Clock Tower Town{i % 7}",) for i in range(40)] + [(f"{i} rue Tol, derrière la Gare Ville{chr(97 + i % 20)}",) for i in range(40)] + [("at 7 Hill Road",), (None,), ("",)] * 30
    df = spark.createDataFrame(rows, "addr string").where("addr is not null")
    assert addresses.learn_landmarks(df) == ("clock tower", "gare")
    assert addresses.learn_landmarks(df.limit(3)) == () and addresses.learn_landmarks(df.limit(0)) == ()


def test_dependent_votes_are_found():
    rnd = np.random.default_rng(5)
    n, same, there = 4000, rnd.random(4000) < 0.5, rnd.random(4000) < 0.5
    noise = rnd.random(n) < 0.3
    votes = {"name": np.where(same ^ noise, 1, 4), "line": np.where(same ^ noise, 1, 2), "given": np.where(same ^ (rnd.random(n) < 0.3), 1, 3)}
    votes |= {v: np.where(there ^ (rnd.random(n) < 0.2), 1, 2) for v in ("number", "street", "town")}
    joint = np.stack([(same == a) & (there == b) for a in (False, True) for b in (False, True)], 1).astype(float)
    assert linkage.votes_that_go_together(votes, np.ones(n), joint) == [("N", ("given",)), ("N", ("name", "line")), ("A", ("number",)), ("A", ("street",)), ("A", ("town",))]


def test_link_addresses(spark):
    rows = [
        (1, "1948 Shetetru Street, Saint Vibrabon, NV 79276", "US", "a"), (2, "01948 SHETETRO ST, ST. VIBRABON", "US", "b"), (3, "1949 Shetetru Street, Saint Vibrabon", "US", "c"),
        (4, "1948 Shetetru Street, Brukrejes, ID", "US", "d"), (5, "Shetetru Street, Saint Vibrabon", "US", "e"), (6, "", "US", "f"), (7, None, None, None), (8, "Floor 3, 1948 Shetetru, 79276", "US", "g"),
        (9, "1948 Shetetru Street, Saint Vibrabon, NV 79276", "US", "a"), (10, "1948 Another Road, Saint Vibrabon", "US", "h"),
    ]
    df = spark.createDataFrame(rows, "gid bigint, addr string, country string, addr_roman string").withColumn("token", F.lit(1)).withColumn("town", F.lit("q"))
    got = sorted(map(tuple, addresses.link_addresses(df, places(spark)).collect()))
    assert got == [(1, 2), (1, 8), (2, 8), (2, 9), (8, 9)]
    assert addresses.link_addresses(df.limit(0), places(spark)).count() == 0


# 4: linkage


def test_link_records(spark):
    rows = [
        (1, "S1-1", "Trimoka Vizalis Foods Ltd", "1948 Shetetru Street, Saint Vibrabon, NV 79276", "US", 1), (2, "S1-2", "Trimoka Vizalis Foods Ltd", "12 Another Lane, Brukrejes, ID", "US", 1),
        (3, "S1-3", "Robert Aber Cofen & Sons", "7 Hill Road, Boviles 441873", "India", 1), (4, "S2-1", "TRIMOKA VIZALIS FDS", "1948 SHETETRU ST, ST. VIBRABON", "US ", 2),
        (5, "S2-2", "Bob Aber Cofen and Sons", "null", "INDIA", 2), (6, "S2-3", None, None, None, 2), (7, "S3-1", "Trimoka Vizalis Foods", "99 Nowhere Court, Brukrejes", "US", 3),
        (8, "S2-1", "TRIMOKA VIZALIS FDS ", "1948 SHETETRU ST, ST. VIBRABON", "US", 2), (9, None, "x", "y", "US", 2), (10, "S3-2", "Vizalis Trimoka Foods", "12 Another Ln, 41277", None, 3),
    ]
    # The model learns from the candidates themselves, so there must be some.
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdfgjklmnprstv") + rnd.choice("aeiou") for _ in range(4))
    towns = ["Saint Vibrabon, NV 79276", "Brukrejes, ID 41277"]
    for k in range(60):
        name, street, town = f"{word()} {word()}", word(), towns[k % 2]
        rows += [(100 + k, f"S1-{100 + k}", f"{name} Foods Inc", f"{k + 20} {street} Street, {town}", "US", 1), (200 + k, f"S2-{100 + k}", f"{name} Foods", f"{k + 20} {street} St, {town}", "US", 2)]
        if k % 3 == 0:
            rows += [(300 + k, f"S1-{300 + k}", f"{name} Foods Inc", f"{k + 220} {word()} Lane, {towns[1 - k % 2]}", "US", 1), (400 + k, f"S1-{400 + k}", f"{word()} {word()} Motors Inc", f"{k + 20} {street} Street, {town}", "US", 1)]
    df = spark.createDataFrame(rows, "row_id bigint, entity_id string, name string, addr string, country string, src int").withColumn("s1", F.lit("q")).withColumn("p", F.lit(1))
    found = linkage.link_records(df, places(spark), vocabulary=WORDS)
    got = {r["rid"]: r["s1"] for r in found.collect()}
    assert found.count() == len(got)
    assert got["S2-1"] == "S1-1" and got["S3-2"] == "S1-2" and "S2-3" not in got and "S3-1" not in got
    assert sum(got.get(f"S2-{100 + k}") == f"S1-{100 + k}" for k in range(60)) >= 55
    assert found.where("confidence < 0.5 or confidence > 1").count() == 0
    assert linkage.link_records(df.limit(0), places(spark)).count() == 0


# 5: look-alikes


@pytest.mark.parametrize(
    "text,want",
    [
        ("Mo­oper", "Mooper"), ("a b　c", "a b c"), ("Ｔｒａ１", "Tra1"), ("café", "café"), ("LΝDRΥ", "LNDRY"), ("Niﬆomal", "Nistomal"), ("Ωμέγα Дружба", None), ("café ™ № 1º", None),
        ("कि‍ज़", None), ("a‍b", "ab"), ("‘x’ – y", None), ("", None), ("plain", None), ("tab\there", "tab here"),
    ],
)
def test_consistent_form(text, want):
    assert unicode_forms.consistent_form(text) == (text if want is None else want, want is not None)
    again = unicode_forms.consistent_form(want if want is not None else text)
    assert again[1] is False


def test_unify_fields(spark):
    rows = [(1, "café A", None), (2, "café A", "x​"), (3, "", "x"), (1, "café A", "x"), (None, "LΝ", "z" * 50000)]
    df = spark.createDataFrame(rows, "id bigint, name string, addr string").withColumn("value", F.lit("q"))
    got = unicode_forms.unify_fields(df, "id", ["name", "addr"])
    assert got.count() == 9
    assert {(r["field"], r["value"]): r["canonical"] for r in got.collect() if r["changed"]} == {("name", "café A"): "café A", ("addr", "x​"): "x", ("name", "LΝ"): "LN"}
    classes = {}
    for r in got.collect():
        classes.setdefault(unicodedata.normalize("NFC", r["mapped"]), set()).add(r["canonical"])
    assert all(len(c) == 1 for c in classes.values())
    assert unicode_forms.unify_fields(df.limit(0), "id", ["name"]).count() == 0


# 6: splits


def test_components_against_union_find(spark):
    rnd = random.Random(6)
    edges = [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(90)] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)] + [("x", None), ("y", "y"), (None, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        for z in (a, b):
            if z:
                find(z)
        if a and b:
            parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in splits.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == set(parent)
    assert len({(find(n), c) for n, c in got.items()}) == len({find(n) for n in parent}) == len(set(got.values()))


def test_components_of_a_long_path_and_a_star(spark, monkeypatch):
    """However long the path, and with hubs joined by ``hot`` or not, the components are the same as in one task."""
    path = [(f"p{i:06}", f"p{i + 1:06}") for i in range(20_000)] + [("hub", f"leaf{i}") for i in range(3000)]
    edges = spark.createDataFrame(path, "a string, b string")
    found = splits.connected_components(edges).groupBy("component").count()
    assert sorted(r["count"] for r in found.collect()) == [3001, 20_001]
    small = spark.createDataFrame(path[:70] + path[-70:], "a string, b string")
    want = sorted(map(tuple, splits.connected_components(small).collect()))
    monkeypatch.setattr(splits, "_HOT", 3)
    assert sorted(map(tuple, splits.connected_components(small, one_task=10).collect())) == want


def test_split_entities(spark):
    cands = [(1, i) for i in range(300)] + [(s, 0) for s in range(2, 900)] + [(None, 1)] * 5 + [(9999, 1)]
    prepared = [(s, f"S1-{s}") for s in range(1, 1000)] + [(2000 + s, f"S2-{s}") for s in range(500)]
    matches = [(f"S1-{s}", f"S2-{s}, S2-{s},") for s in range(2, 200)] + [("S1-2", "S2-3"), ("S1-5", None)]
    args = [
        spark.createDataFrame(cands, "s1 bigint, rid bigint"), spark.createDataFrame(prepared, "gid bigint, entity_id string"),
        spark.createDataFrame([(f"S2-{s}",) for s in range(700)] + [(None,)], "entity_id string"), spark.createDataFrame(matches, "source1_entity_id string, matched_entity_ids string"),
    ]
    rows = splits.split_entities(*args).collect()
    assert len(rows) == len({(r["s1"], r["entity_id"]) for r in rows})
    by_entity = {r["entity_id"]: r["split"] for r in rows if r["entity_id"]}
    assert {f"S2-{s}" for s in range(700)} <= set(by_entity) and all(by_entity[f"S1-{s}"] == by_entity[f"S2-{s}"] for s in range(2, 200)) and by_entity["S1-2"] == by_entity["S1-3"]
    of = {r["s1"]: r["split"] for r in rows if r["s1"] is not None}
    count = {}
    for s, _ in cands:
        if s is not None:
            count[of[s]] = count.get(of[s], 0) + 1
    whole = sum(count.values())
    # One group holds a quarter of all rows; the others fill up to the shares.
    assert abs(count["train"] / whole - 0.8) < 0.01 and abs(count["test"] / whole - 0.1) < 0.01
    again = {(r["s1"], r["entity_id"]): r["split"] for r in splits.split_entities(*args).collect()}
    assert again == {(r["s1"], r["entity_id"]): r["split"] for r in rows}
    assert splits.split_entities(*(a.limit(0) for a in args)).count() == 0


# 7: packing


def test_sum_of_squares():
    rnd = np.random.default_rng(7)
    sizes = rnd.integers(0, 101, 5000)
    place, fill = packing.sum_of_squares(sizes, 100)
    held = np.bincount(place, sizes, len(fill))
    assert (held == fill).all() and fill.max() <= 100
    assert len(fill) <= 1.03 * math.ceil(sizes.sum() / 100)
    assert packing.sum_of_squares(np.zeros(0, int), 10)[1].size == 0


def test_pack_texts(spark):
    texts = ["word " * n for n in (1, 5, 40, 700, 1500, 0)] * 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "x"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit("q"))
    got = packing.pack_texts(df, "doc_id", "text", capacity=512, items_per_shard=60).collect()
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
    assert all(u <= 512 for u in used.values()) and all(used[r["container"]] == r["used"] for r in got)
    enc = packing.encoding(packing.TOKENIZER)
    want = {}
    for i, t in rows:
        if i is not None:
            want[i] = want.get(i, 0) + (len(enc.encode_ordinary(t)) if t else 0)
    have = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["n_tokens"]
    assert have == want
    assert all(sum(1 for r in got if r["doc_id"] == i) == 1 for i, t in rows if i not in (None, 7) and (not t or len(enc.encode_ordinary(t)) <= 512))
    assert packing.pack_texts(df.limit(0), "doc_id", "text").count() == 0


# 8: leakage


def test_leaks_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["aa", "Bb", "cc.", "d-d", "ईश", "1", "x_y"])
    items = [(i, " ".join(word() for _ in range(rnd.randrange(3, 30)))) for i in range(20)] + [(90, None), (91, ""), (None, "a b")]
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(40))) + " " + (rnd.choice(items[:20])[1] if i % 2 else "") + " END") for i in range(120)] + [(500, None), (501, ""), (502, "aa " * 5000), (None, "aa")]

    def grams(t, n):
        w = leakage.words_of(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string")
    for n in (3, 13):
        want = {(a, b) for a, t in docs if a is not None and t for b, u in items if b is not None and u if grams(t, n) & grams(u, n)}
        found = leakage.find_leaks(d, i, n).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
        texts, items_ = dict(docs), dict(items)
        for r in found[:200]:
            a, b = leakage.words_of(texts[r["doc_id"]]), leakage.words_of(items_[r["item_id"]])
            assert a[r["doc_word"] : r["doc_word"] + r["n_words"]] == b[r["item_word"] : r["item_word"] + r["n_words"]]
            assert not (grams(texts[r["doc_id"]], r["n_words"] + 1) & grams(items_[r["item_id"]], r["n_words"] + 1))
    leaks = leakage.find_leaks(d, i)
    assert leakage.without_leaks(d, leaks).where("doc_id is null").count() == 1
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def test_common_passages_come_in_bounded_steps(monkeypatch):
    ids, texts = np.arange(6), ["a b c d e " * 30, "b c d e a b c", "x y z " * 9, "e a b c d q", "", "c d e a " * 4]
    item_texts = [["a b c d e a b c", "z x y z x"], ["c d e a c d"]]
    blocks = [(np.arange(len(t)) + 10 * k, *leakage.word_codes(t)) for k, t in enumerate(item_texts)]

    def best():
        found = {}
        for df in leakage.leaked_in_block(ids, texts, blocks, 3):
            for r in df.itertuples(index=False):
                key = (r.doc_id, r.item_id)
                found[key] = max(found.get(key, (0, 0, 0)), (r.n_words, -r.doc_word, -r.item_word))
        return found

    whole = best()
    assert whole
    for at_once in (1, 2, 7):
        monkeypatch.setattr(leakage, "_SPOTS_AT_ONCE", at_once)
        assert best() == whole


# 9: spans


def brute_spans(docs, length):
    owner = {}
    for d, t in docs:
        for k in range(len(t) - length + 1):
            owner.setdefault(t[k : k + length], set()).add(d)
    out = set()
    for d, t in docs:
        mark = bytearray(len(t) + 1)
        for k in range(len(t) - length + 1):
            if len(owner[t[k : k + length]]) > 1:
                mark[k : k + length] = b"\1" * length
        b = None
        for k, x in enumerate(mark):
            if x and b is None:
                b = k
            if not x and b is not None:
                out.add((d, b, k))
                b = None
    return out


@pytest.mark.parametrize("gather", [20_000, 4])
def test_spans_against_brute_force(spark, gather):
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("abcde é नि😀") for _ in range(rnd.randrange(30, 90))) for _ in range(12)]
    docs = [(i, "".join(rnd.choice(pool) if rnd.random() < 0.5 else "".join(rnd.choice("xyz") for _ in range(rnd.randrange(30))) for _ in range(rnd.randrange(8)))) for i in range(80)]
    docs += [(200, "a" * 300), (201, "a" * 150), (202, docs[0][1]), (203, "ab" * 2000)]
    df = spark.createDataFrame([*docs, (204, None), (None, docs[1][1]), (205, "")], "doc_id bigint, text string").withColumn("h", F.lit(1))
    got = spans.shared_spans(df, 40, 24, gather).collect()
    assert {tuple(r) for r in got} == brute_spans(docs, 40) and len(got) == len({tuple(r) for r in got})
    assert spans.shared_spans(df.limit(0), 40, 24).count() == 0


def test_same_id_shares_nothing_with_itself(spark):
    t = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id bigint, text string")
    assert spans.shared_spans(df).count() == 0
    share = spans.shared_share(df, spans.shared_spans(df.union(spark.createDataFrame([(3, t)], df.schema))))
    assert {r["doc_id"]: r["share"] for r in share.collect()} == {1: 1.0, 2: 0.0}


def test_equal_stretches_are_found_by_the_index():
    """Texts of several owners (-1), alone or beside others, come out whole; a text of one owner only where another has it."""
    t = "abcdefghijklmnopqrst"
    begin, end = spans.shared_range([t, "xx" + t[3:15] + "yy", "zzzzzzzzzzzz"], np.array([-1, 7, 8]), 10)
    assert list(zip(begin, end)) == [(0, 20), (2, 14), (0, 0)]
    assert spans.shared_range([t], np.array([-1]), 10)[1][0] == 20 and spans.shared_range([t], np.array([5]), 10)[1][0] == 0


def test_matching_statistics():
    texts = ["banana", "bandana", "ananas", "xyz"]
    index = FMIndex(texts, np.arange(4))
    for k, t in enumerate(texts):
        for e in range(1, len(t) + 1):
            want = max((n for n in range(1, e + 1) if any(t[e - n : e] in o for j, o in enumerate(texts) if j != k)), default=0)
            assert index.matched(np.array([k]), np.array([e]), 99, np.array([k]))[0] == want


# Blocks of any size are compared in whole


def test_chunks_lose_no_pair(spark):
    rows = [(b, i, i % 3 == 0) for b, n in ((1, 57), (2, 4), (3, 11), (4, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "block bigint, id bigint, listed boolean")

    def met(found, may):
        blocks, seen = {}, []
        for r in found.collect():
            blocks.setdefault(r["block"], []).append(r)
        for b in blocks.values():
            seen += [tuple(sorted((x["id"], y["id"]))) for k, x in enumerate(b) for y in b[k + 1 :] if may(x, y)]
        return sorted(seen)

    ids = {b: [(i, s) for c, i, s in rows if c == b] for b in (1, 2, 3, 4)}
    assert met(in_chunks(df, "id", 10), lambda x, y: x["part"] < 0 or x["part"] != y["part"]) == sorted((i, j) for x in ids.values() for i, _ in x for j, _ in x if i < j)
    assert met(across_chunks(df, "id", "listed", 10), lambda x, y: x["listed"] != y["listed"]) == sorted((i, j) for x in ids.values() for i, s in x for j, t in x if i < j and s != t)


def test_names_of_a_common_block(spark):
    """Reordered words with the line of business left out, and slips at both ends, are found however common the words."""
    forms = ["|manufakturing|trimoka vijalis", "||vijalis trimoka", "||trumoka vijalos", *(f"|{line}|trimoka vijalis" for line in ("fuds", "dairy", "motors"))]
    df = spark.createDataFrame([(i, "US", f) for i, f in enumerate(forms)], "form_id bigint, country string, form string")
    calm = sorted(map(tuple, names.link_forms(df).collect()))
    assert (0, 1) in calm
    assert sorted(map(tuple, names.link_forms(df, too_common=2).collect())) == calm


def test_weights_decide_a_containment():
    """The rarer the number within the town, the less of the street's name must be held; what is missing counts by its weight."""
    df = pd.DataFrame({"town": "t", "number": "7", "street": ["shetetru", "shetakru", "shetetru"], "kind": ["lane", "lane", ""], "w_number": 9.0, "w_street": 8.0, "w_kind": [2.5, 2.5, 0.0]})
    pairs = np.array([0, 0, 1]), np.array([1, 2, 2])
    assert addresses.same_building(df, *pairs).tolist() == [True, True, True]
    assert addresses.same_building(df.assign(w_number=1.0), *pairs).tolist() == [False, True, False]
    assert addresses.same_building(df.assign(kind=["lane", "road", ""]), *pairs).tolist() == [False, True, True]


def test_two_established_spellings_meet(spark):
    at = lambda street, *numbers: [(str(n), street, "street", "US/a") for n in numbers]
    rows = at("shetetru", 1948, 2, 3, 4) + at("shetetro", 1948, 5, 6, 7) + [r for s in ("bavolin", "kermudas", "ploquix", "zandwyf", "hugrint", "myncoste") for r in at(s, 1948)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "form_id bigint, number string, street string, kind string, town string")
    assert [tuple(r) for r in addresses.link_buildings(df).collect()] == [(0, 4)]


def test_streets_of_a_very_common_number(spark):
    rnd = random.Random(9)
    streets = ["bolmaterringhaus", "kolmaterringhaux"] + list({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(2100)})
    df = spark.createDataFrame([(i, "1", s, "", "US/a") for i, s in enumerate(streets)], "form_id bigint, number string, street string, kind string, town string")
    assert (0, 1) in [tuple(r) for r in addresses.link_buildings(df).collect()]


def test_candidates_of_common_blocks(spark):
    """A record without an address, a slip in the number, other words at one address: met in a large block as in a small one."""
    rows = [(i, i % 2 == 0, "US", "trimoka vijalis fuds", str(100 + i), f"street{chr(97 + i)}x", "street", "US/a") for i in range(12)]
    rows += [(20, False, "US", "trimoka vijalis fuds", "", "", "", ""), (21, False, "US", "trumoka vijalis fuds", "109", "", "", ""), (22, False, "US", "vijalis trimoka", "", "", "", "US/a")]
    entities = spark.createDataFrame(rows, linkage._ENTITY)
    calm = sorted(map(tuple, linkage.candidate_votes(entities, WORDS).collect()))
    assert {(s, r) for s, r, *_ in calm} >= {(s, r) for s in range(0, 12, 2) for r in (20, 21)}
    assert sorted(map(tuple, linkage.candidate_votes(entities, WORDS, too_common=2).collect())) == calm


def test_candidates_of_a_common_building(spark):
    """Entities of one building whose names share neither beginning nor end meet, however many there are."""
    rows = [(i, i % 2 == 0, "US", a, "7", "hill", "road", "US/a") for i, a in enumerate(("gomada", "pilevu", "trenok", "basulo", "fedriv", "mokanu", "zulpit", "havern"))]
    entities = spark.createDataFrame(rows, linkage._ENTITY)
    assert sorted((r["s1"], r["rid"]) for r in linkage.candidate_votes(entities, WORDS, too_common=2).collect()) == [(s, r) for s in range(0, 8, 2) for r in range(1, 8, 2)]


# 5: letters of any script


@pytest.mark.parametrize("letter", ["ꓮ", "Ⲁ", "א", "ب", "ꭰ", "ꬰ", "ǀ", "ʰ", "µ", "株", "𐐀", "ᎪА"])
def test_foreign_letter_in_a_latin_word(spark, letter):
    """By property, as the query's SQL has it: any letter outside the ordinary Latin ranges, and never one beside them only."""
    df = spark.createDataFrame([(0, f"Mo{letter}per"), (1, f"Mooper {letter}")], "id bigint, name string")
    got = {r["id"]: r["changed"] for r in unicode_forms.unify_fields(df, "id", ["name"]).collect()}
    assert got[0] and not got[1]


def test_the_class_decides_what_changed(spark):
    """Consistent forms are fixed points; joiners inside Indic words and texts in other scripts keep their spelling."""
    texts = ["Mo株per", "x̂y", "Caf́e", "Cafе́", "ﬁ​Ωx", "Ｍо́o", "ǃx̄ a", "plain", "Дружба й"]
    for t in texts:
        form, changed = unicode_forms.consistent_form(t)
        assert unicode_forms.consistent_form(form) == (form, False) and changed == (form != t)
    rows = [(i, t) for i, t in enumerate(["कि‍ज़", "किज़", "किज़", "Дружба й", "Дружба й", "café", "café", "café", "Cafe", "Саfe", "Саfe"])]
    got = {r["id"] for r in unicode_forms.unify_fields(spark.createDataFrame(rows, "id bigint, name string"), "id", ["name"]).where("changed").collect()}
    odd = {i for i, t in rows if unicode_forms.consistent_form(t)[1]}
    assert got == odd


def test_indic_letters_are_not_foreign():
    assert unicode_forms.consistent_form("Кафе कabc ªº") == ("Кафе कabc ªº", False)
