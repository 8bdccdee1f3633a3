"""Free-entered citations mapped to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.skew import salted
from docketry.sources.tables import checkpointed

# Words that say which number follows, and words without meaning here.
FIRST_NUMBER = {"title", "tit", "vol", "volume"}
SECOND_NUMBER = {"§", "§§", "sec", "section", "sections", "sect", "s", "ss", "part", "parts", "pt", "p", "pp", "page", "at"}
EMPTY_WORDS = {"the", "of", "and", "series", "rep", "reports", "reporter"}
# Words for the number of a reporter's series.
SERIES = {"second": "2d", "third": "3d", "fourth": "4th"}

_NAMED = re.compile(r"^\s*(?:matter\s+of\s+\w+|in\s+re\s+\w+|[^\W\d]+(?:\s+[^\W\d]+){0,4}\s+vs?\.\s+[^\W\d]+(?:\s+[^\W\d]+){0,4})\s*,", re.IGNORECASE)
_BRACKETS = re.compile(r" ?\([^()]*\)")
_DECIMALS = re.compile(r"(?<=\d)\.\d+")
_LEXEMES = re.compile(r"(?P<order>(?<![0-9])[234](?:d|th)(?![a-z0-9]))|(?P<number>(?:(?<![a-z])[lo])?[0-9][0-9lo]*(?:[a-e](?![a-z0-9&+]))?)|(?P<word>§+|[^\W\d_]+)")
_DIGITS = str.maketrans("lo", "10")


def read_citation(value: str) -> tuple[list[str], str | None, str | None, bool]:
    """The words of a typed citation, its first and second number (title or volume, section or page), and whether a case
    name led it.

    Case, width, accents, punctuation and blanks count for nothing; single letters in a row are one word; what stands in brackets or
    behind a number's point (subsections) is dropped; l and o between digits are digits.
    """
    s = " ".join(unicodedata.normalize("NFKC", value).lower().split())
    named = _NAMED.match(s)
    if named:
        s = s[named.end() :]
    s = _DECIMALS.sub("", _BRACKETS.sub(" ", s))
    found = [(m.lastgroup, m[0]) for m in _LEXEMES.finditer(s)]
    words: list[str] = []
    first = second = None
    loose: list[str] = []
    run = ""
    for i, (kind, text) in enumerate(found):
        following = found[i + 1][0] if i + 1 < len(found) else None
        if kind == "number":
            number = text[:-1].translate(_DIGITS) + text[-1] if text[-1] in "abcde" else text.translate(_DIGITS)
            before = found[i - 1][1] if i and found[i - 1][0] == "word" else ""
            if before in FIRST_NUMBER and first is None:
                first = number
            elif before in SECOND_NUMBER and before != "at" and second is None:
                second = number
            else:
                loose.append(number)
        if kind == "word" and len(text) == 1 and text.isalpha() and not (text in SECOND_NUMBER and following == "number" and len(run) not in (1, 2)):
            run += text
            continue
        if kind == "word" and text in EMPTY_WORDS and run and following == "word" and len(found[i + 1][1]) == 1:
            continue
        if run:
            words.append(run)
            run = ""
        marks = text in FIRST_NUMBER or text in SECOND_NUMBER
        if kind == "order" or kind == "word" and not marks and text not in EMPTY_WORDS:
            words.append(SERIES.get(text, text))
    if run:
        words.append(run)
    if first is None and (second is None or loose) and len(loose) + (second is not None) > 1:
        first = loose.pop(0)
    if second is None and loose:
        second = loose.pop(0)
    return words, first, second, bool(named)


def _reader():
    @F.pandas_udf("words array<string>, first string, second string, named boolean")
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_citation(v) for v in values], columns=["words", "first", "second", "named"])

    return read


def deletes(c: Column, most: Column) -> Column:
    """A word and what is left of it without one letter, or without two where `most` is 2: the keys of a symmetric-delete index."""

    def without(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = without(c)
    return F.array_distinct(F.concat(F.array(c), F.when(most >= 1, one).otherwise(F.array()), F.when(most >= 2, F.flatten(F.transform(one, without))).otherwise(F.array())))


def edits_allowed(length: Column) -> Column:
    """How deep the index of a word of this length goes: none for those so short that any two are alike, one letter below nine,
    else two. What an edit is worth is `likeness`; a longer word has no fewer."""
    return F.when(length < 4, 0).when(length < 9, 1).otherwise(2)


def likeness(edits: Column, length: Column) -> Column:
    """How sure it is that a word missed by so many edits is meant: the fewer words of a length there are, the less."""
    return F.when(edits == 0, F.lit(1.0)).otherwise(1 - edits / F.greatest(length - 2, F.lit(1)) ** 2)


def edits(a: Column, b: Column) -> Column:
    """Edit distance in which two neighbouring letters exchanged count as one edit, once in a word."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    distance = F.levenshtein(a, b)
    return F.when((distance == 2) & swapped, 1).otherwise(distance)


#: What a typed word is worth that a written abbreviation of the reference list abbreviates, and how much heavier than the rarest
#: word of the list one weighs that the list doesn't have.
ABBREVIATED, UNKNOWN_WEIGHT = 0.9, 1.5


def written_forms(canons: DataFrame) -> DataFrame:
    """scheme, form, words, short: the ways to write the schemes of the reference list, all taken from its displays: their words, and
    where the words' initials are the scheme's id, that. `short` are the words that the displays themselves abbreviate.
    """
    scheme = F.substring_index("canon_id", ":", 1)
    one = canons.filter(F.col("display").isNotNull() & F.col("canon_id").contains(":")).groupBy(scheme.alias("scheme")).agg(F.min("display").alias("display"))
    read = one.withColumn("words", _reader()("display")["words"]).filter(F.size("words") > 0)
    letters = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    signs = F.regexp_extract_all(F.lower("display"), F.lit(r"([a-z]+)(?=\.)|([a-z])(?=&)|(?<=&)([a-z])"), 0)
    dotted = F.array_join(signs, "")
    short = F.filter("words", lambda w: F.array_contains(signs, w) | (F.length(w) > 1) & F.contains(dotted, w))
    full = read.select("scheme", "words", short.alias("short"))
    initials = read.filter((letters == F.col("scheme")) & (F.size("words") > 1)).select("scheme", F.array("scheme").alias("words"), F.array().cast("array<string>").alias("short"))
    return full.unionByName(initials).withColumn("form", F.xxhash64("scheme", F.concat_ws(" ", "words")))


def _vocabulary(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, scheme, form, places, short) of every word and every run of words written as one in the forms; (form, place, weight)
    of the forms' words, by inverse frequency among the forms."""
    places = forms.select("scheme", "form", "short", F.posexplode("words").alias("place", "word"))
    n = forms.select(F.count(F.lit(1))).scalar()
    idf = places.groupBy("word").agg(F.log(1 + n / F.count_distinct("form")).alias("idf"))
    weights = places.join(idf, "word").select("form", "place", (F.col("idf") ** 2).alias("weight"), F.col("word").alias("of_word"))
    run = lambda i, k: F.array_join(F.slice("words", i + 1, k), "")
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.size("words") - i), lambda k: F.struct(i.alias("i"), k.alias("k"), run(i, k).alias("word"))))), lambda s: F.length(s["word"]) > 0)
    words = forms.select("scheme", "form", "short", F.explode(spans).alias("s"))
    places_of = F.sequence(F.col("s.i"), F.col("s.i") + F.col("s.k") - 1)
    return words.select("s.word", "scheme", "form", places_of.alias("places"), ((F.col("s.k") == 1) & F.array_contains("short", F.col("s.word"))).alias("short")), weights


def form_thresholds(forms: DataFrame, weights: DataFrame) -> DataFrame:
    """form, norm, threshold: fitted on the reference list alone. Half way between the score of the form with all its words missed by
    as many edits as the index allows and its common words left out, and the best that a wrong one gets: a distinctive word
    missing, or an unknown one added."""
    top = weights.agg(F.max("weight").alias("w")).select("w").scalar()
    length = F.length("of_word")
    kept = F.when(edits_allowed(length) > 0, likeness(edits_allowed(length), length)).otherwise(1.0)
    distinct = F.col("weight") > top / 2
    by = weights.groupBy("form").agg(
        F.sum("weight").alias("norm"), F.sum(F.when(distinct, kept * F.col("weight"))).alias("missed"), F.sum(F.when(distinct, F.col("weight"))).alias("rest"), F.min(F.when(distinct, F.col("weight"))).alias("least"),
    )
    right = F.col("missed") / F.sqrt("norm") / F.sqrt("rest")
    wrong = F.greatest(F.sqrt((F.col("norm") - F.col("least")) / F.col("norm")), F.sqrt(F.col("norm") / (F.col("norm") + UNKNOWN_WEIGHT**2 * top)))
    return by.select("form", "norm", F.when(right > wrong, (right + wrong) / 2).otherwise(wrong + (1 - wrong) / 4).alias("threshold"))


def form_scores(texts: DataFrame, canons: DataFrame) -> DataFrame:
    """sig, scheme, score: the written forms that each list of typed words (sig, words) means, by soft TF-IDF at or above the form's threshold.

    Each distinct typed word, and each run of up to four as their initials (or the first word and the others' initials), is joined to the reference vocabulary: through a
    symmetric-delete index of edits, or as what a written abbreviation abbreviates. All words of the vocabulary at the least
    distance are kept; the score chooses. A form's score is the cosine of its words and the typed ones: typed words that
    stand for none of the form's count against it, with the weight that they have in the list, or more if the list has them not.
    """
    forms = checkpointed(written_forms(canons))  # what is of the reference list doesn't grow; read once, the plans stay short
    vocabulary, weights = map(checkpointed, _vocabulary(forms))
    thresholds = checkpointed(form_thresholds(forms, weights).join(forms.select("form", "scheme"), "form"))
    top = weights.agg(F.max("weight").alias("w")).select("w").scalar()
    size = F.size("words")
    letters = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    run = lambda token, i, k: F.struct(token.alias("token"), F.sequence(i, i + k - 1).alias("at"), F.lit(True).alias("initials"))
    spelt = lambda i, k: F.array(run(letters(F.slice("words", i + 1, k)), i, k), run(F.concat(F.get("words", i), letters(F.slice("words", i + 2, k - 1))), i, k))
    runs = F.flatten(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.transform(F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))), lambda i: spelt(i, k)))))
    single = F.transform("words", lambda w, i: F.struct(w.alias("token"), F.array(i).alias("at"), F.lit(False).alias("initials")))
    typed = checkpointed(texts.select("sig", F.explode(F.concat(single, F.filter(runs, lambda r: F.size("words") > F.element_at(r["at"], -1)))).alias("t")).select("sig", "t.*"))
    known = vocabulary.select("word").distinct()
    used = typed.filter(~F.col("initials")).select("token").distinct()
    index = known.select("word", F.explode(deletes(F.col("word"), edits_allowed(F.length("word")))).alias("key"))
    near = used.select("token", F.explode(deletes(F.col("token"), edits_allowed(F.length("token") + 1))).alias("key")).join(index, "key").select("token", "word").distinct()
    near = near.withColumn("edits", edits(F.col("token"), F.col("word"))).filter(F.col("edits") <= edits_allowed(F.length("word")))
    least = near.groupBy("token").agg(F.min("edits").alias("least"))
    near = checkpointed(near.join(least, "token").filter(F.col("edits") == F.col("least")).select("token", "word", likeness(F.col("edits"), F.length("word")).alias("like"), F.lit(False).alias("initials")))
    shorts = vocabulary.filter("short").select("word").distinct()
    first = shorts.withColumn("letter", F.substring("word", 1, 1))
    long = used.withColumn("letter", F.substring("token", 1, 1)).join(first, "letter").filter(F.length("token") > F.length("word"))
    ends = (F.length("word") == 2) & (F.substring("token", -1, 1) == F.substring("word", 2, 1))
    long = long.filter(F.startswith("token", "word") | ends).select("token", "word", F.lit(ABBREVIATED).alias("like"), F.lit(False).alias("initials"))
    spelled = typed.filter("initials").select("token").distinct().join(shorts.select(F.col("word").alias("token")), "token").select("token", F.col("token").alias("word"), F.lit(ABBREVIATED).alias("like"), F.lit(True).alias("initials"))
    means = near.unionByName(long).unionByName(spelled).groupBy("token", "word", "initials").agg(F.max("like").alias("like"))
    hits = checkpointed(typed.join(means, ["token", "initials"]).join(vocabulary, "word").select("sig", "at", "scheme", "form", "places", "like"))
    covered = hits.select("sig", "form", F.explode("places").alias("place"), "like").groupBy("sig", "form", "place").agg(F.max("like").alias("like")).join(weights, ["form", "place"])
    dots = covered.groupBy("sig", "form").agg(F.sum(F.col("like") * F.col("weight")).alias("dot"), F.sum("weight").alias("own"))
    # What else was typed: with the weight of the vocabulary's word, or that of an unknown one.
    heaviest = weights.groupBy(F.col("of_word").alias("word")).agg(F.max("weight").alias("weight"))
    value = used.join(near.join(heaviest, "word").groupBy("token").agg(F.max("weight").alias("weight")), "token", "left").select("token", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT**2) * top).alias("typed_weight"))
    there = hits.select("sig", "form", F.explode("at").alias("i")).distinct()
    places = typed.filter(~F.col("initials")).select("sig", "token", F.col("at")[0].alias("i")).join(value, "token")
    total = places.groupBy("sig").agg(F.sum("typed_weight").alias("all_weight"))
    met = there.join(places, ["sig", "i"]).groupBy("sig", "form").agg(F.sum("typed_weight").alias("met_weight"))
    rows = dots.join(met, ["sig", "form"]).join(total, "sig").join(thresholds, "form")
    score = F.col("dot") / F.sqrt("norm") / F.sqrt(F.col("own") + F.greatest(F.col("all_weight") - F.col("met_weight"), F.lit(0.0)))
    return rows.withColumn("score", score).filter(F.col("score") >= F.col("threshold")).groupBy("sig", "scheme").agg(F.max("score").alias("score"))


def mapped_values(values: DataFrame, canons: DataFrame) -> DataFrame:
    """value, canon_id, score for each distinct `value` that means an entry of `canons` (canon_id, display); no row for others.

    A value is read into words and numbers. Its words are repaired and scored against the written forms of the list (form_scores),
    once for all values with the same words. Entries are joined on scheme and numbers, which are words that nothing repairs but
    l and o between digits; of those the best score is taken (ties: the smallest canon_id).

    The reference list doesn't grow with the data; its size is checked by what plans the joins. Null and empty values mean nothing.
    """
    read = values.select("value").filter(F.col("value").isNotNull()).distinct().withColumn("r", _reader()("value")).select("value", "r.*")
    read = checkpointed(read.filter(F.col("second").isNotNull() & (F.size("words") > 0)).withColumn("sig", F.array_join("words", " ")))
    scored = form_scores(checkpointed(read.groupBy("sig").agg(F.first("words").alias("words"))), canons)
    entry = F.regexp_extract_all("canon_id", F.lit(r"(\d+[a-z]?)(?=_|$)"), 1)
    entries = canons.select("canon_id", F.substring_index("canon_id", ":", 1).alias("scheme"), F.when(F.size(entry) > 1, entry[0]).alias("e_first"), F.element_at(entry, -1).alias("second"))
    joined = read.select("value", "sig", "first", "second").join(entries, "second").filter(F.col("first").eqNullSafe(F.col("e_first"))).join(scored, ["sig", "scheme"])
    best = joined.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "canon_id")).alias("b"))
    return best.select("value", F.col("b.canon_id").alias("canon_id"), (-F.col("b.s")).alias("score"))


#: Values with at least this share of the rows are hot: at most 100.
HOT_SHARE = 0.01


def mapped_rows(rows: DataFrame, canons: DataFrame) -> DataFrame:
    """tbl, row_key, value, canon_id for distinct rows (tbl, row_key, value) with a value; canon_id is null where the value
    means no entry, and that of the entry itself where the value is its display.

    Values are mapped once each; the mapping is joined back with hot values salted.
    """
    rows = rows.filter(F.col("value").isNotNull())
    counts = checkpointed(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    total = rows.select(F.count(F.lit(1))).scalar()
    hot = counts.filter(F.col("n") >= total * F.lit(HOT_SHARE)).select("value")
    mapped = checkpointed(mapped_values(counts, canons).select("value", "canon_id"))
    left, right = salted(rows, mapped, hot, "value", F.col("row_key"))
    return left.join(right, ["value", "salt"], "left").select("tbl", "row_key", "value", "canon_id").distinct()
