"""One form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.skew import salted

# Letters that look alike, at the same place of each line. A dot stands for a letter without a twin.
LATIN = "aceijopsxy" "ABCEHIJKMNOPSTXYZ" "hdqwl"
CYRILLIC = "асеіјорѕху" "АВСЕНІЈКМ.ОРЅТХ.." "һԁԛԝӏ"
GREEK = "....ϳο...." "ΑΒ.ΕΗΙͿΚΜΝΟΡ.ΤΧΥΖ" "....."

# Arabic letters that look alike only at some places of a word, at the same place of each line: kaf and keheh
# and the two yehs before a letter that joins to them; the yehs without dots, where none follows.
ARABIC_JOINED, ARABIC_FREE = "\u0643\u064a", "\u0649"
PERSIAN_JOINED, PERSIAN_FREE = "\u06a9\u06cc", "\u06cc"

# Invisible characters. The two joiners and the variation selectors count only where they change the look.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ﻿ﾠ"
JOINERS = "‌‍"
SELECTORS = "︎️"
LINE_ENDS = "\u0085  \u000b\u000c\r"
HYPHENS = "‐‑"

#: Compatibility characters that differ from their plain form in width alone, or not at all: ligatures, digraphs, Roman
#: numerals and radicals. Those that differ in height or style (superscripts, bold, circled) are not among them.
SAME_LOOK_BLOCKS = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xFB00, 0xFB17))


@cache
def _tables() -> tuple[dict, dict, dict, dict]:
    """Plain forms of characters; prototypes of look-alike letters; and from the prototypes to Cyrillic and to Greek."""
    plain: dict[int, str | None] = {}
    for cp in range(0x80, 0x10000):
        kind, _, rest = unicodedata.decomposition(chr(cp)).partition("> ")
        codes = "".join(chr(int(x, 16)) for x in rest.split())
        if kind in ("<wide", "<narrow") or kind == "<compat" and any(a <= cp <= b for a, b in SAME_LOOK_BLOCKS):
            plain[cp] = unicodedata.normalize("NFD", codes)
        elif unicodedata.category(chr(cp)) == "Zs":
            plain[cp] = " "
    plain |= {0x3000: " ", 0x09: " "} | {ord(c): "\n" for c in LINE_ENDS} | {ord(c): "-" for c in HYPHENS} | {ord(c): None for c in INVISIBLE}
    proto, to = {}, ({}, {})
    for script, back in ((CYRILLIC, to[0]), (GREEK, to[1])):
        for latin, other in zip(LATIN, script, strict=True):
            if other != ".":
                proto[ord(other)] = latin
                back[latin] = other
    return plain, proto, *to


@cache
def _changed() -> re.Pattern:
    """Any character that has another plain form."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_tables()[0])) + "]")


_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_OWN = (re.compile(r"[Ѐ-ԯ]"), re.compile(r"[Ͱ-Ͽ]"))
_EITHER = re.compile("[Ͱ-ԯ]")
_OURS = re.compile("[A-Za-z\u00c0-\u024f\u0370-\u052f\u1e00-\u1fff]")
_SHAPERS = re.compile(f"[{JOINERS}{SELECTORS}]")
# Joiners shape Arabic and Syriac letters and Indic signs, and bind emoji; selectors choose the look of a symbol.
_IDLE_JOINER = re.compile("(?<![؀-޿ࢠ-ࣿऀ-෿က-႟←-⯿️\U0001f000-\U0001faff])[‌‍]+|[‌‍]+(?![؀-޿ࢠ-ࣿऀ-෿က-႟←-⯿\U0001f000-\U0001faff])")
_IDLE_SELECTOR = re.compile("(?<![#*0-9©® -⯿〰〽㊗㊙\U0001f000-\U0001faff])[︎️]+")

_PERSIAN_LETTERS = "\u0679\u067e\u0686\u0688\u0691\u0698\u06af\u06ba\u06be\u06c1\u06d2"
_PERSIAN = re.compile(f"[{PERSIAN_JOINED}{_PERSIAN_LETTERS}]")
# Arabic letters join to the one before, but for the hamza alone and few others; a tatweel and a joiner act as a letter, marks don't count.
_MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed\u08ca-\u08ff\u0300-\u036f]*"
_JOINS = _MARKS + "(?:[\u0620\u0622-\u064a\u066e\u066f\u0671-\u0673\u0675-\u06d3\u06d5\u06ee\u06ef\u06fa-\u06fc\u06ff\u0750-\u077f\u0870-\u0882\u0886\u0889-\u088e\u08a0-\u08ac\u08ae-\u08c8]|\u200d)"
_HAMZA = _MARKS + "[\u0654\u0655]"  # takes the dots of one yeh and not of the other
_JOINED = {script: re.compile(f"[{letters}](?={_JOINS})(?!{_HAMZA})") for script, letters in (("Arabic", ARABIC_JOINED), ("Persian", PERSIAN_JOINED))}
_FREE = {script: re.compile(f"{letter}(?!{_JOINS})(?!{_HAMZA})") for script, letter in (("Arabic", ARABIC_FREE), ("Persian", PERSIAN_FREE))}
# What only one of the two ways to write has, whatever its look-alikes are.
_ARABIC_ONLY = re.compile(f"\u0629|[{ARABIC_JOINED}](?!{_JOINS})")
_PERSIAN_ONLY = re.compile(f"[{_PERSIAN_LETTERS}]|\u06a9(?!{_JOINS})")


def _arabic_form(s: str) -> str:
    """The composed text with Arabic letters that look the same where they stand as one: the Arabic ones, or the Persian ones
    in a text with more letters that only Persian or Urdu has than such that only Arabic has."""
    if not _PERSIAN.search(s):
        return s
    s = _JOINED["Persian"].sub(lambda m: ARABIC_JOINED[PERSIAN_JOINED.index(m[0])], s)
    s = _FREE["Persian"].sub(ARABIC_FREE, s)
    if len(_PERSIAN_ONLY.findall(s)) > len(_ARABIC_ONLY.findall(s)):
        s = _JOINED["Arabic"].sub(lambda m: PERSIAN_JOINED[ARABIC_JOINED.index(m[0])], s)
        s = _FREE["Arabic"].sub(PERSIAN_FREE, s)
    return s


SCRIPTS = ("Latin", "Cyrillic", "Greek")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].capitalize()


@lru_cache(maxsize=4)
def public_confusables(app: str, spark: SparkSession) -> dict[str, dict[str, str]]:
    """For each letter of a script other than SCRIPTS, its look-alikes among theirs, by script: letters with the same skeleton in
    Unicode's confusables data (in the ICU library that Spark brings along) and of the same case. `app` tells sessions apart."""
    letters = [chr(c) for c in range(0x41, 0x12000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(chr(c)) and not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7FF)]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    plain: dict[tuple[str, str, str], str] = {}
    for c, skeleton in zip(letters, skeletons, strict=True):
        script = _script(c)
        if script in SCRIPTS and c in _basic_letters():
            plain.setdefault((skeleton, unicodedata.category(c), script), c)
    out: dict[str, dict[str, str]] = {}
    for c, skeleton in zip(letters, skeletons, strict=True):
        if _script(c) not in (*SCRIPTS, "Cjk", "Hangul", "Katakana", "Hiragana"):
            twins = {script: plain[key] for script in SCRIPTS if (key := (skeleton, unicodedata.category(c), script)) in plain}
            if twins:
                out[c] = twins
    return out


@cache
def _basic_letters() -> frozenset[str]:
    """The letters with which the three scripts are ordinarily written, accents aside."""
    ranges = ((0x41, 0x5A), (0x61, 0x7A), (0x391, 0x3A9), (0x3B1, 0x3C9), (0x400, 0x45F))
    return frozenset(chr(c) for a, b in ranges for c in range(a, b + 1))


@lru_cache(maxsize=200_000)
def token_scripts(token: str) -> frozenset[str]:
    """The scripts in which every letter of the token (in prototype spelling) exists: the resolved script set of the token
    and of all that looks like it. Empty: the token mixes scripts for good."""
    out = set()
    if not any(p.search(token) for p in _OWN):
        out.add("Latin")
    for name, own, other, back in (("Cyrillic", *_OWN, _tables()[2]), ("Greek", _OWN[1], _OWN[0], _tables()[3])):
        if not other.search(token) and all(c in back or own.match(c) or unicodedata.combining(c) for c in token):
            out.add(name)
    return frozenset(out)


def _resolved(token: str, wide: dict[str, dict[str, str]]) -> str:
    """A token (in prototype spelling) that mixes letters of SCRIPTS with such of another script: spelled with their look-alikes in
    the first of the three in which all its letters then are; as it is, if none has them all or nothing is mixed."""
    rest = [c for c in token if c not in wide and not unicodedata.combining(c)]
    if not rest or not all(_OURS.match(c) for c in rest):
        return token  # one foreign script alone
    for script in SCRIPTS:
        spelled = "".join([wide[c].get(script, c).translate(_tables()[1]) if c in wide else c for c in token])
        if script in token_scripts(spelled) and not any(c in wide for c in spelled):
            return spelled
    return token


def consistent(text: str, wide: dict[str, dict[str, str]] | None = None) -> str:
    """The text in the one form that all texts have that look the same: plain width, one kind of blank, no invisible
    characters, accents composed, and every word in one script where it can be.

    Words are compared in prototype spelling, so the outcome depends on the look alone. A word is spelled in the only script
    that has all its letters; if several have (whole-script look-alikes), in the one that most other words of the text need;
    if none has, letters stay prototypes. A word that mixes one of the three scripts with letters of another one (Armenian,
    Cherokee, Coptic ...) is spelled with their look-alikes of `wide` (public_confusables), if these put all of it in one script; a word
    of such a script alone stays. Arabic letters that look alike only before a letter that joins to them, or only where
    none follows, are compared there. Digits, case, marks, line breaks and the number of blanks are kept.
    """
    plain, proto, to_cyrillic, to_greek = _tables()
    s = text.replace("\r\n", "\n") if "\r" in text else text
    if _changed().search(s):
        s = s.translate(plain)
    if s.isascii():
        return s
    if _SHAPERS.search(s):
        s = _IDLE_SELECTOR.sub("", _IDLE_JOINER.sub("", s))
    foreign = bool(wide) and not wide.keys().isdisjoint(s)
    if not foreign and not _EITHER.search(s):
        return _arabic_form(unicodedata.normalize("NFC", s))
    s = unicodedata.normalize("NFD", s).translate(proto)
    if foreign:
        s = _TOKEN.sub(lambda m: _resolved(m[0], wide) if not wide.keys().isdisjoint(m[0]) else m[0], s)
    if _EITHER.search(s):
        tokens = _TOKEN.findall(s)
        need = {"Latin": 0, "Cyrillic": 0, "Greek": 0}
        for t in tokens:
            if len(scripts := token_scripts(t)) == 1:
                need[next(iter(scripts))] += 1
        back = {"Cyrillic": to_cyrillic, "Greek": to_greek}

        def spell(m: re.Match) -> str:
            scripts = token_scripts(m[0])
            best = max(sorted(scripts, reverse=True), key=need.__getitem__) if len(scripts) > 1 else next(iter(scripts), "Latin")
            return m[0] if best == "Latin" else "".join([back[best].get(c, c) for c in m[0]])

        s = _TOKEN.sub(spell, s)
    return _arabic_form(unicodedata.normalize("NFC", s))


def _udf():
    spark = SparkSession.active()
    wide = public_confusables(spark.sparkContext.applicationId, spark)  # a few hundred letters, whatever the data

    @F.pandas_udf("string")
    def one_form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: consistent(t, wide), na_action="ignore")

    return one_form.asNondeterministic()  # else a plan that uses the form twice computes it twice


def consistent_form(c: Column) -> Column:
    """`consistent` as a column; null for null. Plain ASCII without tabs or carriage returns never goes to Python."""
    simple = c.rlike(r"^[\x0A\x20-\x7E]*$")
    return F.when(simple, c).otherwise(_udf()(F.when(simple, F.lit(None)).otherwise(c)))


def look_classes(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, look, raw (hashes of the form and of the text itself) of every document with a visible character.

    Null texts and those without a visible character have no row.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).withColumn("form", consistent_form(F.col("t")))
    rows = rows.filter(F.col("form").rlike(r"(?U)[^\s\p{Cc}\p{Cf}\p{Zs}\x{FE0E}\x{FE0F}]"))
    return rows.select("doc_id", F.unhex(F.sha2("form", 256)).alias("look"), F.unhex(F.sha2("t", 256)).alias("raw"))


def alike(classes: DataFrame) -> DataFrame:
    """Pairs doc_a < doc_b of documents that look the same but differ in characters, from look_classes.

    Pairs are made of different texts (look, raw) first, so copies of one text never meet, however many there are; the two sides of
    a pair are then expanded to their documents, with texts of very many copies split over salts.
    """
    rows = classes.select("doc_id", "look", "raw").distinct()
    texts = rows.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"))
    mixed = texts.groupBy("look").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("look")
    texts = texts.join(mixed, "look", "left_semi")
    pairs = texts.select("look", F.col("raw").alias("raw_a")).join(texts.select("look", F.col("raw").alias("raw_b")), "look").filter(F.col("raw_a") < F.col("raw_b"))
    hot = texts.filter(F.col("n") >= rows.select(F.count(F.lit(1))).scalar() * F.lit(0.01)).select("raw").distinct()
    for side in ("a", "b"):
        members, right = salted(rows.select("doc_id", "raw"), pairs.withColumnRenamed(f"raw_{side}", "raw"), hot, "raw", F.col("doc_id"))
        pairs = members.join(right, ["raw", "salt"]).drop("raw", "salt").withColumnRenamed("doc_id", f"doc_{side}")
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).filter(F.col("doc_a") != F.col("doc_b")).distinct()
