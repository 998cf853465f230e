"""One consistent form of text that looks the same but is made of other characters.

Plan: the distinct values of the fields are collected once (a hash aggregate); only those with a
suspicious character (a JVM regular expression) go through the Arrow mapper that exchanges look-alikes.
All values are then grouped by the mapped text under an accent-sensitive Unicode collation, a member
per class is chosen, and the choice is joined back to the values. A field had to change if and only if its
value is not its class's member: a mapped text is its own mapped text, so no value that the mapper changes is one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlink.session import cut

# Letters of other scripts, and Latin ones outside the ordinary alphabet, with the
# ordinary letters that they look like.
LOOKALIKES = (
    "АA ВB ЕE ЅS ІI ЇÏ ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ҺH ԌG ԚQ ԜW ЁË "
    "аa ВB сc ԁd еe һh іi їï јj оo рp ԛq ѕs уy хx ѵv ԝw үy ёë гr кk мm нh тt пn вb иu "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ ΆÁ ΈÉ ΉH ΊÍ ΌÓ ΎÝ "
    "αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ϲc ϳj άá έé ίí όó ύú μu σo ϱp "
    "ɑa ɡg ɩi ɪi ʏy ʟl ɴn ʀr ʜh ɢg ʙb ᴀa ᴄc ᴅd ᴇe ᴊj ᴋk ᴍm ᴏo ᴘp ᴛt ᴜu ᴠv ᴡw ᴢz ꜱs ǃl ıi ȷj "
    "օo ոn սu հh ցg ՏS ՕO ԼL ՍU"
)  # fixed values end
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f"
_BLANKS = "\t\n\x0b\x0c\r\x1c-\x1f\x85   -     　"
_INDIC = "ऀ-෿"
# Letters that are not ordinary Latin: any but these ranges, and some inside them.
_ORDINARY = "A-Za-zªºÀ-ɏḀ-ỿ" + _INDIC
_ODD_LATIN = "ıȷǀ-ǃ"


@cache
def compatibility_forms() -> dict[str, str]:
    """Letters and digits whose compatibility form is plain ASCII, full width or an Arabic shape.

    Raised and lowered signs (the ordinal signs, the trade mark) and signs such as the number sign are none.
    """
    forms = {}
    for code in range(0x80, 0x1F200):
        ch = chr(code)
        if unicodedata.category(ch)[0] not in "LN":
            continue
        tag = unicodedata.decomposition(ch).partition(">")[0].lstrip("<") if unicodedata.decomposition(ch).startswith("<") else ""
        if tag not in ("wide", "narrow", "font", "compat", "circle", "initial", "medial", "final", "isolated"):
            continue
        to = unicodedata.normalize("NFKC", ch)
        if (to.isascii() and to.isalnum()) or 0xFB50 <= code <= 0xFEFC or 0xFF00 <= code <= 0xFFEF:
            forms[ch] = to
    return forms


def _class_of(chars) -> str:
    """A regular expression class body of these characters, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


@cache
def _tools():
    table = {ord(k): v for k, v in compatibility_forms().items()}
    look = {pair[0]: pair[1] for pair in LOOKALIKES.split()}
    mark = "[̀-ͯ᪰-᫿᷀-᷿⃐-⃰]"
    return (
        table,
        look,
        re.compile(f"[{_class_of(compatibility_forms())}]"),
        re.compile(f"(?<![{_INDIC}])[‌‍]+|[‌‍]+(?![{_INDIC}‌‍])"),
        re.compile(f"[{_INVISIBLE.replace(chr(0x200b) + '-' + chr(0x200f), chr(0x200b) + chr(0x200e) + chr(0x200f))}]"),
        re.compile(f"[{_BLANKS}]"),
        re.compile(f"[A-Za-zÀ-ɏḀ-ỿ]{mark}+"),
        re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|{mark})*"),
        re.compile(f"[^\\W\\d_{_ORDINARY}]|[{_ODD_LATIN}]"),
    )


def is_ordinary_latin(ch: str) -> bool:
    """Letters of the Latin alphabet, plain or precomposed with an accent, and the ordinary extra ones."""
    return ch.isascii() or "À" <= ch <= "ɏ" and ch not in "ǀǁǂǃıȷ" or "Ḁ" <= ch <= "ỿ"


def consistent_form(text: str) -> tuple[str, bool]:
    """``text`` in its consistent form, and whether a character had to change.

    An accent that no precomposed letter has is dropped; a foreign letter that looks like no ordinary one is set apart
    from the Latin letters beside it by blanks. So the consistent form of a consistent form is itself.
    """
    if text.isascii() and not re.search("[\x00-\x1f\x7f]", text):
        return text, False
    table, look, compat, joiner, invisible, blank, accented, word, other = _tools()
    out = joiner.sub("", text)
    out = invisible.sub("", out)
    out = blank.sub(" ", out)
    if compat.search(out):
        out = out.translate(table)
    if accented.search(out):
        out = accented.sub(lambda m: unicodedata.normalize("NFC", m[0]), out)
        out = accented.sub(lambda m: m[0][0], out)
    if other.search(out):

        def foreign(ch: str) -> bool:
            return ch.isalpha() and not is_ordinary_latin(ch) and ch not in "ªº" and not "ऀ" <= ch <= "෿"

        def mend(m: re.Match) -> str:
            w = m[0]
            if not any(map(foreign, w)) or not any(ch.isalpha() and is_ordinary_latin(ch) for ch in w):
                return w
            w = "".join(look.get(ch, ch) for ch in w)
            apart = "".join(f" {ch} " if foreign(ch) else ch for ch in w)
            return w if apart == w else re.sub(" +", " ", apart).strip()

        out = word.sub(mend, out)
        if accented.search(out):
            return consistent_form(out)[0], True
    return out, out != text


def suspicious_pattern() -> str:
    """Regular expression (Java) of every character that a value must hold for ``consistent_form`` to change it.

    Code points that Java does not know yet may be letters to Python, so they count too.
    """
    return f"[{_INVISIBLE}{_BLANKS}̀-ͯ᪰-᫿᷀-᷿⃐-⃰{_ODD_LATIN}{_class_of(compatibility_forms())}[\\p{{L}}\\p{{Cn}}&&[^{_ORDINARY}]]]"


def _map_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"value": df["value"], "mapped": [consistent_form(v)[0] for v in df["value"]], "n": df["n"]})


def canonical_values(values: DataFrame) -> DataFrame:
    """``value, mapped, canonical`` of every distinct value of ``values(value)``.

    ``mapped`` is the value with its look-alikes exchanged. Values whose mapped text is equal under the
    accent-sensitive collation UNICODE form a class, as far as their characters outside the Latin alphabet are the
    same: an Indic word with a joiner is another word. The class's canonical member is the mapped text borne by
    most rows, ties by the smaller text in byte order. NULL values are left out; the empty text is its own class.
    """
    counted = values.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # Text without a byte above 127 and without controls, most of all text, needs no look at the long character class.
    ascii_only = (F.octet_length("value") == F.char_length("value")) & ~F.col("value").rlike("[\\x00-\\x1f\\x7f]")
    counted = cut(counted.withColumn("suspicious", F.when(ascii_only, False).otherwise(F.col("value").rlike(suspicious_pattern()))))
    plain = counted.where("not suspicious").select("value", F.col("value").alias("mapped"), "n")
    odd = counted.where("suspicious").select("value", "n").mapInPandas(_map_values, "value string, mapped string, n bigint")
    others = F.when(F.octet_length("mapped") == F.char_length("mapped"), "").otherwise(F.regexp_replace("mapped", "[\\x00-\\u024F\\u1E00-\\u1EFF]", ""))
    # Members of a class have the same plain letters and digits: sorted by their hash first, few texts need a collated comparison.
    letters = F.xxhash64(F.regexp_replace("mapped", "[^A-Za-z0-9]+", ""))
    spelled = plain.unionByName(odd).withColumns({"letters": letters, "others": others})
    members = spelled.groupBy("letters", "others", "mapped").agg(F.sum("n").alias("n")).withColumn("form", F.collate("mapped", "UNICODE"))
    first = F.min(F.struct((-F.col("n")).alias("k"), F.col("mapped").alias("m")))["m"]
    classes = members.groupBy("letters", "others", "form").agg(first.alias("member"), F.count(F.lit(1)).alias("members"))
    # A text that is alone in its class is its canonical member, so only the other classes are joined back.
    several = classes.where("members > 1").select("letters", "others", F.col("form").alias("class"), "member")
    same = F.when(F.collate("mapped", "UNICODE") == F.col("class"), True).otherwise(False)
    l, r = spelled.alias("l"), several.alias("r")
    joined = l.join(r, (F.col("l.letters") == F.col("r.letters")) & (F.col("l.others") == F.col("r.others")) & same, "left")
    return joined.select("value", "mapped", F.coalesce("member", "mapped").alias("canonical"))


def unify_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, value, mapped, canonical, changed`` for every non-NULL value of ``fields``.

    One row for each row of ``df`` and field, also when keys repeat; NULL fields make no row. ``changed`` says that the
    value is not its class's canonical member. Only ``key`` and ``fields`` are read, so extra columns don't matter.
    """
    long = df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select(key, "x.field", "x.value").where("value is not null")
    forms = canonical_values(long.select("value"))
    return long.join(forms, "value").select(key, "field", "value", "mapped", "canonical", (F.col("value") != F.col("canonical")).alias("changed"))
