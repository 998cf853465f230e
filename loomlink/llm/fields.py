"""Names and addresses of organisations taken apart."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from loomlink.llm.lcs import lcs, ratio
from loomlink.llm.unicode_forms import consistent_form

# Letters by their place in a block of an Indian script (the blocks are laid out alike).
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ng ch chh j jh n t th d dh n t th d dh n n p f b bh m y r r l l l v sh sh s h".split()))
_VOWELS = dict(zip(range(0x05, 0x15), "a a i i u u r l e e e ai o o o au".split()))
_SIGNS = dict(zip(range(0x3E, 0x4D), "a i i u u r r e e e ai o o o au".split()))
# Legal forms and words that say nothing about which organisation it is.
LEGAL = set("private pvt p limited ltd lt inc incorporated llc llp lp corp corporation co company sarl sas sa eurl cie compagnie".split())
FILLER = set("the and m s ms messrs c o co of at null group groupe services service house centre center enterprises enterprise agency works shop outlet maison atelier original since official www com".split())
# fixed values end


def romanise(text: str) -> str:
    """Indian letters written with Latin ones; a consonant without a vowel sign has an `a` inside a word only."""
    out = []
    for i, ch in enumerate(text):
        code = ord(ch)
        if not 0x900 <= code < 0xD80:
            out.append(ch)
            continue
        place = code & 0x7F
        if place in _CONSONANTS:
            out.append(_CONSONANTS[place])
            after = ord(text[i + 1]) if i + 1 < len(text) else 0
            if 0x900 <= after < 0xD80 and (after & 0x7F) in _CONSONANTS:
                out.append("a")
        elif place in _VOWELS:
            out.append(_VOWELS[place])
        elif place in _SIGNS:
            out.append(_SIGNS[place])
        elif place in (1, 2):
            out.append("n")
        elif 0x66 <= place <= 0x6F:
            out.append(str(place - 0x66))
    return "".join(out)


def plain_text(text: str) -> str:
    """Lower-case, in one consistent form, without accents and joiners, Indian scripts romanised."""
    if text.isascii():
        return text.lower()
    text = consistent_form(text)[0].lower()
    if not text.isascii():
        text = "".join(ch for ch in unicodedata.normalize("NFD", text) if not "̀" <= ch <= "ͯ")
        text = romanise(unicodedata.normalize("NFC", text)).replace("‌", "").replace("‍", "").replace("’", "").replace("œ", "oe")
    return text


_FOLD = str.maketrans({"c": "k", "q": "k", "z": "j", "w": "v", "x": "ks", "y": "i"})
_TWICE = re.compile(r"(.)\1+")


@lru_cache(1 << 17)
def fold(word: str) -> str:
    """A word by its sound: letters that are written for each other become one, doubled letters single."""
    word = word.replace("ph", "f").translate(_FOLD)
    word = word.replace("oo", "u").replace("ee", "i")
    return _TWICE.sub(r"\1", word)


class Name(NamedTuple):
    given: str
    words: tuple[str, ...]
    line: str


class Vocabulary(NamedTuple):
    """Folded generic words of names with the folded word that each stands for: lines of business, and first names."""

    lines: dict[str, str] = {}
    given: dict[str, str] = {}


_DOMAIN = re.compile(r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)(?:\.[a-z]{2,})+/?$")
_SPLIT = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"\b(?:l\W*l\W*[cp]|s\W*a\W*(?:r\W*l|s)?|p\W*(?:vt|riv)?\W+l\W*t\W*d)\W*$")
_EXTRA = re.compile(r"[‘'`\"]?\b(?:since)\b.*$|\bc\s*/\s*o\b|\bm\s*/\s*s\b|\bd\s*/?\s*b\s*/?\s*a\b")
_LEGAL_FOLDS = [(w, fold(w)) for w in ("private", "limited", "incorporated", "corporation", "company")]


@lru_cache(1 << 17)
def _folded(word: str) -> str:
    """A word of a name by its sound; empty if it is a legal form, a filler, or in other than Latin letters."""
    if word in LEGAL or word in FILLER:
        return ""
    f = fold(word)
    if len(f) >= 4 and any(f == g or word[0] == w[0] and ratio(word, w) >= 0.85 for w, g in _LEGAL_FOLDS):
        return ""
    return f if f.isascii() and f.isalpha() else ""


def name_tokens(text: str) -> str:
    """The words of an organisation's name by their sound, each once, and a letter that may be an initial; `@ ` first, if it is an address of the web."""
    text = plain_text(text).strip().replace("™", "")
    m = _DOMAIN.match(text) if "." in text else None
    if m:
        text = m[1]
    text = _LETTERS.sub(" ", _EXTRA.sub(" ", text)).replace("'", "")
    tokens = [t for t in _SPLIT.findall(text) if not t.isdigit()]
    out = {}
    for i, t in enumerate(tokens):
        if len(t) == 1:
            if len(tokens) > 2 and (i == 0 or f", {t}" in text) and "a" <= t <= "z":
                out[fold(t)[0]] = None
        elif f := _folded(t):
            out[f] = None
    return ("@ " if m else "") + " ".join(out)


class NameParser:
    """Takes names apart by a vocabulary; words near a generic one are slips of it."""

    def __init__(self, vocabulary: Vocabulary):
        self.lines, self.given = vocabulary
        self.line_ends, self.given_ends = sorted(set(self.lines.values())), sorted(set(self.given.values()))
        self.known: dict[str, tuple[str, str]] = {}

    def kind(self, f: str) -> tuple[str, str]:
        """What a folded word is: ``("line" | "given" | "word", the word it stands for)``."""
        if f in self.lines:
            return "line", self.lines[f]
        if f in self.given:
            return "given", self.given[f]
        if len(f) < 4:
            return "word", f
        got = self.known.get(f)
        if got is None:
            near = [(ratio(f, k), k, "line") for k in self.line_ends if k[0] == f[0] or k[-3:] == f[-3:] and len(f) > 6]
            near += [(ratio(f, k), k, "given") for k in self.given_ends if k[0] == f[0] or k[-3:] == f[-3:]]
            best = max(near, default=(0, "", ""))
            if len(self.known) > 1 << 17:
                self.known.clear()
            got = self.known[f] = (best[2], best[1]) if best[0] >= 0.8 else ("word", f)
        return got

    def parse(self, tokens: str) -> Name:
        """First name, proper words and line of business of a name's tokens."""
        web = tokens.startswith("@")
        given, line, words = "", "", []
        for t in tokens[2:].split() if web else tokens.split():
            if len(t) == 1:
                given = given or t
                continue
            kind, form = self.kind(t)
            if kind == "line":
                line = form
            elif kind == "given":
                given = form
            else:
                if len(form) > 10:
                    for k in self.line_ends:
                        if not line and form.endswith(k) and len(form) >= len(k) + 4 and len(k) >= 4:
                            line, form = k, form[: -len(k)]
                    for k in self.given_ends:
                        if form.startswith(k) and len(form) >= len(k) + 4 and len(k) >= 4:
                            given, form = k, form[len(k) :]
                    for k, v in sorted(self.given.items()) if web and not given else ():
                        if form.startswith(k) and len(k) >= 3 and len(form) >= len(k) + 10:
                            given, form = v, form[len(k) :]
                if len(form) >= 2 and form not in words:
                    words.append(form)
        if not words and len(given) > 1 and not line:
            words, given = [given], ""
        return Name(given, tuple(words), line)


def parse_name(text: str, vocabulary: Vocabulary = Vocabulary()) -> Name:
    """First name, proper words (folded) and line of business of an organisation's name."""
    return NameParser(vocabulary).parse(name_tokens(text))


class Address(NamedTuple):
    number: str
    street: str
    kind: str
    town: str
    unit: str


# Kinds of streets with the short forms in use, words before a house number, a flat or a landmark.
STREETS = {
    "lane": "ln la", "road": "rd raod", "street": "st str strt", "avenue": "ave av avn", "boulevard": "blvd bvd boul bd bld", "drive": "dr drv", "parkway": "pkwy pky pkw", "court": "ct crt",
    "marg": "mg mrg", "nagar": "ngr nagr", "chowk": "chk chauk", "salai": "sal sali", "rue": "r", "chemin": "che ch chem", "route": "rt rte", "allee": "all", "impasse": "imp", "place": "pl", "quai": "q",
}
_UNITS = "suite|ste|unit|floor|fl|flat|shop|bat|batiment|etage|et|apt|room"
_MARKS = "near|nr|at|opposite|opp|behind|beside|next to|pres de|pres|derriere|a cote d[eu]|face a|en face de|face"
# fixed values end
_KINDS = {s: k for k, v in STREETS.items() for s in [k, *v.split()]}
_ARTICLES = r"\.?\W*(?:(?:la|le|l|du|de|the)\W+)*"
_MARKED = re.compile(rf"\b(?:{_MARKS})\b{_ARTICLES}\b([a-z]+)\b(?: ([a-z]+)\b)?")


def _away(landmarks: tuple[str, ...]) -> re.Pattern:
    """What says nothing about the building: countries, box numbers, floors, landmarks."""
    known = rf"|\b(?:{_MARKS})\b{_ARTICLES}(?:{'|'.join(map(re.escape, landmarks))})\b" if landmarks else ""
    return re.compile(
        rf"\(1\s*o\)|\bnull\b|\bp\.?\s*o\.?\s*box\W*\d+|\bbharat\b|\bindia\b|\busa?\b|\bfrance\b|\bfr\b|\bpin\b"
        rf"|(?:\b\d+(?:st|nd|rd|th)\W+)+(?:floor|fl)\b{known}"
        rf"|\b(?:near|opposite|opp|behind|beside|derriere|a cote d[eu]|face a)\b[^,;]*(?=[,;])"
    )


def marked_places(text: str) -> list[tuple[str, str]]:
    """The one or two words (the second may be empty) after each word that leads to a landmark."""
    return [(m[1], m[2] or "") for m in _MARKED.finditer(_NR.sub(" ", plain_text(text).replace("'", " ")))]


_TOWN_WORDS = ("port", "pt", "st", "ste", "saint")
_NR = re.compile(r"\bnr\b\.?(?=\W*\d)")
_UNIT = re.compile(rf"(?:\b(?:{_UNITS})\b\W*)+(?:no\W*)?(\d+)\b")
_NUMBER_WORDS = re.compile(r"\b(?:h|plot|door|house)?\W{0,2}\b(?:no|number|num)\b\.?|\b(?:plot|door)\b|[#№]")
_PARTS = re.compile(r"[a-z]+|\d+[a-z]*|[,;]")
_PIN = re.compile(r"(?<!\d)([1-9]\d{2}) ?(\d{3})(?!\d)")
_ZIP = re.compile(r"(?<!\d)([1-9]\d{2})\d{2}(?:-\d{4})?(?!\d)")


class Gazetteer:
    """Towns of the countries by name and postcode; states and landmarks are only recognised to be set aside."""

    def __init__(self, rows: list[tuple], landmarks: tuple[str, ...] = ()):
        self.away = _away(landmarks)
        self.by_code, self.by_name, self.names, self.states, self.prints = {}, {}, {}, {}, {}
        for country, city, state, code, prefix in rows:
            words = plain_text(city or "").replace("-", " ").split()
            key = fold("".join(words))
            town = f"{country}/{key}"
            if prefix:
                self.by_code[country, prefix] = town
            self.by_name[country, key] = town
            self.names.setdefault(country, {})[key] = town
            for part in (key[:2], key[-3:]):
                self.prints.setdefault((country, part), set()).add(key)
            away = self.states.setdefault(country, set())
            away.update(fold(w) for w in re.findall(r"[a-z]+", plain_text(state or "").replace("'", " ")))
            if code:
                away.add(code.lower())
        self.long_states = {c: [s for s in v if len(s) >= 5] for c, v in self.states.items()}

    @lru_cache(1 << 16)
    def nearest(self, country: str, word: str) -> str | None:
        """The town whose name is spelled like ``word``."""
        if len(word) < 5:
            return None
        options = self.prints.get((country, word[:2]), set()) | self.prints.get((country, word[-3:]), set())
        best = max(((ratio(word, k), k) for k in options), default=(0, ""))
        return self.names[country][best[1]] if best[0] >= 0.76 else None

    @lru_cache(1 << 16)
    def is_state(self, country: str, word: str) -> bool:
        away = self.states.get(country, set())
        f = fold(word)
        return word in away or f in away or len(f) >= 6 and any(abs(len(s) - len(f)) < 3 and ratio(s, f) >= 0.84 for s in self.long_states.get(country, []))


def parse_address(text: str, country: str, towns: Gazetteer) -> Address:
    """House number, street (folded), kind of street, town and unit; what isn't said is empty.

    Leading zeros of the number are dropped. The town comes from its name, else from the postcode; the other
    of the two is then only set aside.
    """
    if not text:
        return Address("", "", "", "", "")
    s = plain_text(text).replace("º", "o")
    if "'" in s:
        s = s.replace("'", " ")
    s = towns.away.sub(" ", _NR.sub(" ", s))
    unit = ""
    if m := _UNIT.search(s):
        unit = m[1].lstrip("0")
        s = _UNIT.sub(" ", s)
    s = _NUMBER_WORDS.sub(" ", s)
    coded = ""
    for m in reversed(list((_PIN if country == "India" else _ZIP).finditer(s))):
        coded = towns.by_code.get((country, m[1]), "")
        if coded:
            s = f"{s[: m.start()]} , {s[m.end() :]}"
            break
    parts = _PARTS.findall(s)
    number, named, kind, spot = "", "", "", -1
    left: list[str] = []
    names, by = towns.names.get(country, {}), 0
    while by < len(parts):
        p = parts[by]
        by += 1
        if p in ",;":
            left.append("")
            continue
        if p[0].isdigit():
            digits = re.match(r"\d+", p)[0].lstrip("0")
            if not number and digits:
                number = digits
            left.append("")
            continue
        if by < len(parts) and parts[by].isalpha():
            two = fold(("saint" if p in ("st", "ste") else "port" if p == "pt" else p) + parts[by])
            found = names.get(two)
            if not found and p in _TOWN_WORDS and (near := towns.nearest(country, two)):
                found = near if near == coded or not coded and p in ("port", "saint") else None
            if found and not named:
                named = found
                by += 1
                left.append("")
                continue
        f = fold(p)
        if f in names and not named:
            named = names[f]
            left.append("")
            continue
        if towns.is_state(country, p) and p not in _KINDS:
            left.append("")
            continue
        if p in _KINDS and not kind and p != "st":
            kind, spot = _KINDS[p], len(left)
            left.append("")
            continue
        left.append(p)
    if not kind and "st" in left:
        kind, spot = "street", left.index("st")
        left[spot] = ""
    town = named or coded
    code_name = coded.partition("/")[2]
    if not named:
        if coded:
            # The word most like the town of the postcode is the town's name, unless it is the only word.
            best, many = (0.0, -1, -1), sum(map(bool, left)) > 1
            for k, w in enumerate(left):
                if w and many:
                    best = max(best, (ratio(fold(w), code_name) - 0.05 * (abs(k - spot) == 1 and spot >= 0), k, k))
                    if k + 1 < len(left) and left[k + 1]:
                        best = max(best, (ratio(fold(w + left[k + 1]), code_name), k, k + 1))
            if best[0] >= 0.7:
                for k in range(best[1], best[2] + 1):
                    left[k] = ""
        else:
            for k in reversed(range(len(left))):
                w = left[k]
                if not w:
                    continue
                two = fold(left[k - 1] + w) if k and left[k - 1] else ""
                if two and (found := towns.nearest(country, two)):
                    town, left[k], left[k - 1] = found, "", ""
                    break
                # The word beside the kind of street is the street's.
                beside = spot >= 0 and k - spot == (1 if country == "France" else -1)
                if not beside and sum(map(bool, left)) > 1 and (found := towns.nearest(country, fold(w))):
                    town, left[k] = found, ""
                    break
    words: list[str] = []
    if spot >= 0:
        k = spot + 1 if country == "France" else spot - 1
        step = 1 if country == "France" else -1
        while 0 <= k < len(left) and left[k]:
            words.append(left[k])
            k += step
        if step < 0:
            words.reverse()
    if not words:
        words = [w for w in left if w]
    street = fold("".join(dict.fromkeys(w for w in words if w not in ("saint", "de", "du", "la", "le", "o"))))
    return Address(number, street if len(street) >= 3 else "", kind, town, unit)
