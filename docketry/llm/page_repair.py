"""Repair of scanned pages over a whole corpus: what is noise on each page, and each case's continuous text."""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.canonical import deletes
from docketry.llm.scan_noise import (
    DELETED_UP_TO, HEADINGS, MOST_COST, PART, Page, RunReader, breaks, confusion_distance, edge_lines, fold_misread, inner_lines, is_number, judged_breaks, line_runs, nearest_names, page_words, read_pages, read_run,
    reversed_confusions, run_words, whole_pages,
)
from docketry.operators.skew import salted
from docketry.sources.tables import checkpointed

#: A word is common, and may be what a misread one was, from this count on; those with this share of all words (at most a
#: million have it) are broadcast, the rarer ones joined to the units that ask for them.
COMMON_LEAST, COMMON_SHARE = 10, 1e-6
#: A line is a running one if it stands at the edges of so many pages, and there in this share of all its occurrences, whatever the
#: corpus's size. Those with RUNNING_SHARE of all edge lines (at most 5,000 are) are broadcast, the others joined to their units.
RUNNING_LEAST, RUNNING_AT_EDGE, RUNNING_SHARE = 5, 0.8, 2e-4
#: A word is a misreading only of words that are so many times as frequent.
TIMES = 10
#: Places in the bit map by which pairs of words are told apart that nobody asks for; the map has 2 MB.
PAIR_BITS = 1 << 24
#: By which the first word's checksum is multiplied, so that the order of two words counts.
PAIR_STEP = 31

_UNIT = "unit_id", "case_id", "header", "numbers", "texts", "marked_numbers", "marked_texts"


def _unit_rows(units: DataFrame) -> DataFrame:
    """Units with their pages as plain arrays, of the marked texts only the markers of parts. Null arrays are empty."""
    empty_i, empty_s = F.array().cast("array<int>"), F.array().cast("array<string>")
    return units.select(
        "unit_id",
        "case_id",
        "header",
        F.coalesce(F.map_keys("raw_pages"), empty_i).alias("numbers"),
        F.coalesce(F.map_values("raw_pages"), empty_s).alias("texts"),
        F.coalesce(F.transform("pages", lambda p: p["page"]), empty_i).alias("marked_numbers"),
        F.coalesce(F.transform("pages", lambda p: F.array_join(F.regexp_extract_all(p["text"], F.lit(PART), F.lit(0)), "")), empty_s).alias("marked_texts"),
    )


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _place(unit_id: str | None) -> tuple[int, int]:
    """The unit's number in its case and their count; a unit without them is alone."""
    m = re.search(r"__u(\d+)of(\d+)$", unit_id or "")
    return (int(m[1]), int(m[2])) if m else (1, 1)


def _read(row: tuple, running: set[str]) -> tuple[list[Page], bool]:
    unit_id, _, header, numbers, texts, marked_numbers, marked_texts = row
    i, n = _place(unit_id)
    raw = [(int(p), t) for p, t in zip(numbers, texts, strict=True) if p is not None and p == p]
    marked = [(int(p), t) for p, t in zip(marked_numbers, marked_texts, strict=True) if p is not None and p == p]
    return read_pages(raw, marked, header, i == 1, running), i == n


def page_statistics(units: DataFrame) -> DataFrame:
    """kind, key, n over all units: words (w), with those that have a hyphen, words with signs that can't be in one (s), lines at the
    edges of pages (e) and like lines elsewhere (l). Each batch is counted before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs: Counter[str] = Counter()
            kinds: dict[str, Counter[str]] = {k: Counter() for k in "wsel"}
            for row in _tuples(batch):
                pages, ends = _read(row, set())
                runs.update(line_runs(pages))
                kinds["e"].update(edge_lines(pages))
                for page in pages:
                    if not page.first:
                        kinds["l"].update(inner_lines(page))
                kinds["s"].update([w for b in breaks(pages, ends) for w in _signed(b.left + b.right)])
            words = kinds["w"]
            for run, n in runs.items():
                for w in run_words(run):
                    words[w] += n
                for w in _signed(run):
                    kinds["s"][w] += n
            yield _batch([(kind, k, n) for kind, counted in kinds.items() for k, n in counted.items()], _COUNTED)

    return _unit_rows(units).mapInArrow(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


_COUNTED = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())])
_SIGN = re.compile("[0-9†!]")


def _signed(run: str) -> list[str]:
    """The words of a string that bear signs which can't be in them, numbers aside."""
    return [t.lower() for t, sure in read_run(run) if sure and not is_number(t)] if _SIGN.search(run) else []


def index_keys(word: Column, *, asked: bool) -> Column:
    """The keys by which words that two edits may make of one another meet: what is left without up to two letters (so that two at
    least are left), or for long words their thirds with their place, on the asking side shifted by up to two and for lengths up to
    two off."""
    length = F.length(word)
    third = lambda n, j: (n * j / 3).cast("int")
    part = lambda n, j, by: F.concat(F.lit(f"{j}:"), n.cast("string"), F.lit(":"), F.substring(word, F.greatest(third(n, j) + by + 1, F.lit(1)), third(n, j + 1) - third(n, j)))
    off = range(-2, 3) if asked else (0,)
    thirds = F.array_distinct(F.array(*[part(length + d, j, F.lit(by)) for d in off for j in range(3) for by in off]))
    return F.when(length <= DELETED_UP_TO, deletes(word, F.least(length - 2, F.lit(2)))).otherwise(thirds)


def misread_words(words: DataFrame, least: int) -> DataFrame:
    """token, n, repairs (array of struct<cost, count, word>, best first) for words (key, n, and kind if some bear signs) that may be
    misreadings of common ones.

    Both sides meet in a symmetric-delete index; of those the weighted edit distance keeps what confusions explain.
    """
    usable = words.filter(F.length("key") >= 3)
    plain = usable.filter(F.col("kind") == "w") if "kind" in words.columns else usable
    frequent = plain.filter(F.col("n") >= least)
    index = frequent.select(F.col("key").alias("word"), F.col("n").alias("count"), F.explode(index_keys(F.col("key"), asked=False)).alias("part"))
    asking = usable.groupBy("key").agg(F.max("n").alias("n"))
    pairs = asking.select(F.col("key").alias("token"), "n", F.explode(index_keys(F.col("key"), asked=True)).alias("part")).join(index, "part")
    pairs = pairs.filter((F.col("token") != F.col("word")) & (F.col("count") >= F.col("n") * TIMES)).select("token", "n", "word", "count").distinct()

    @F.pandas_udf("double")
    def cost(tokens: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([confusion_distance(a, b) for a, b in zip(tokens, true, strict=True)], dtype="float64")

    kept = pairs.withColumn("cost", cost("token", "word")).filter(F.col("cost").isNotNull() & ~F.isnan("cost"))
    return kept.groupBy("token").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("cost", (-F.col("count")).alias("count"), "word"))).alias("repairs"))


class Lexicon:
    """What repair needs of the corpus. Of bounded size and broadcast: the most frequent of the common words with counts, and of the
    running lines. The others are joined to the units that ask for them (`rare`; None if all are broadcast), and the table of
    words that may be misread isn't broadcast at all."""

    def __init__(self, units: DataFrame) -> None:
        spark = units.sparkSession
        self.statistics = checkpointed(page_statistics(units))
        totals = dict(self.statistics.groupBy("kind").agg(F.sum("n").alias("n")).collect())
        self.least = max(COMMON_LEAST, int((totals.get("w") or 0) * COMMON_SHARE))
        words = self.statistics.filter(F.col("kind").isin("w", "s"))
        self.misread = checkpointed(misread_words(words, COMMON_LEAST))
        common = words.filter((F.col("kind") == "w") & (F.col("n") >= COMMON_LEAST)).select("key", "n").join(self.misread.select(F.col("token").alias("key")), "key", "left_anti")
        self.common = spark.sparkContext.broadcast(dict(common.filter(F.col("n") >= self.least).collect()))
        lines = self.statistics.filter(F.col("kind").isin("e", "l")).groupBy("key").agg(F.sum(F.when(F.col("kind") == "e", F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("everywhere"))
        lines = lines.filter((F.col("n") >= RUNNING_LEAST) & (F.col("n") >= RUNNING_AT_EDGE * F.col("everywhere")))
        shared = int((totals.get("e") or 0) * RUNNING_SHARE)
        self.running = spark.sparkContext.broadcast({r[0] for r in lines.filter(F.col("n") >= shared).select("key").collect()})
        rare = None
        if self.least > COMMON_LEAST:
            rare = common.filter(F.col("n") < self.least)
        if shared > RUNNING_LEAST:
            few = lines.filter(F.col("n") < shared).select(F.concat(F.lit(LINE), "key").alias("key"), "n")
            rare = few if rare is None else rare.unionByName(few)
        self.rare = None if rare is None else checkpointed(_rare_counts(units, rare, self.common, self.running))


#: Marks lines among the words that a unit asks for.
LINE = "\n"


def _asked_words(pages: list[Page], ends: bool, header: str, common: dict[str, int], read: RunReader) -> set[str]:
    """All words but the broadcast ones whose counts repair of the pages may look up."""
    out = {w.lower() for w in re.findall(r"[^\W\d_]+", header)}
    found = breaks(pages, ends)
    runs: set[str] = set()
    for _, text in whole_pages(pages, [(b, True) for b in found]):
        runs.update(text.split())
    ends_of = {(p.page, i): line for p in pages for i, line in enumerate(p.body)} if found else {}
    for b in found:
        if b.mark == "-":  # the only mark that may be part of the word
            compound = f"{b.left}-{b.right}".lower()
            out.update((b.left.lower() + "-", (b.left + b.right).lower(), compound, *reversed_confusions(compound)))
            runs.add((ends_of[b.page, b.line].rstrip()[:-1] + "-" + b.right).split()[-1])
    out.update(w[1] for run in runs for w in read[run] if not w[3])
    return {w for w in out if w not in common}


def _rare_counts(units: DataFrame, rare: DataFrame, common: Broadcast, running: Broadcast) -> DataFrame:
    """asker, rare (map<word, n>): those of the words of `rare` (key, n) that a unit asks for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = RunReader(common.value)
        for batch in batches:
            out = []
            for row in _tuples(batch):
                pages, ends = _read(row, running.value)
                out += [(row[0], w) for w in _asked_words(pages, ends, row[2] or "", common.value, read)]
                out += [(row[0], LINE + f) for f in edge_lines(pages) if f not in running.value]
            yield _batch(out, _ASKED)

    asked = checkpointed(_unit_rows(units).mapInArrow(ask, "asker string, word string").distinct())
    hot = asked.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= asked.select(F.count(F.lit(1))).scalar() * F.lit(0.01)).select("word")
    left, right = salted(asked, rare.withColumnRenamed("key", "word"), hot, "word", F.col("asker"))
    return left.join(right, ["word", "salt"]).groupBy("asker").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("rare"))


_ASKED = pa.schema([("asker", pa.string()), ("word", pa.string())])


def _known_rows(units: DataFrame, lexicon: Lexicon) -> DataFrame:
    """_unit_rows with `rare`, the counts of the common words that aren't broadcast but that the unit asks for; null if none."""
    rows = _unit_rows(units)
    if lexicon.rare is None:
        return rows.withColumn("rare", F.lit(None).cast("map<string, bigint>"))
    return rows.join(lexicon.rare, F.col("unit_id").eqNullSafe(F.col("asker")), "left").drop("asker")


def _running(rare: list | dict | None, running: set[str]) -> set[str]:
    """The running lines that matter to a unit."""
    own = {k[len(LINE) :] for k in dict(rare) if k.startswith(LINE)} if rare is not None and len(rare) else None
    return running | own if own else running


def _known(rare: list | dict | None, common: dict[str, int]) -> Mapping[str, int]:
    """The common words that matter to a unit."""
    return ChainMap(dict(rare), common) if rare is not None and len(rare) else common


def noise_rows(units: DataFrame, lexicon: Lexicon) -> DataFrame:
    """unit_id, case_id, page, noise, token, before, after, repair: header, pageno and hyphen noise of each page, ocr noise in numbers and
    in names that the unit itself has, and with noise `?` each other word that isn't common, or `!` if it bears signs that can't
    be in it, with its neighbours. One row of a unit at a time."""
    common, running = lexicon.common, lexicon.running

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = running.value
        read = RunReader(common.value)
        for batch in batches:
            out = []
            for row in _tuples(batch):
                unit, case = row[0], row[1]
                pages, ends = _read(row[:7], _running(row[7], lines))
                known = _known(row[7], common.value)
                words, places, broken = page_words(pages, ends, known, read)
                for p in pages:
                    out += [(unit, case, p.page, kind, None, None, None, None) for kind, there in (("header", p.header), ("pageno", p.pageno)) if there]
                out += [(unit, case, b.page, "hyphen", None, None, None, None) for b, noise in broken if noise]
                out += _word_rows(unit, case, words, places, row[2] or "", known)
            yield _batch(out, _NOISE)

    return _known_rows(units, lexicon).mapInArrow(scan, "unit_id string, case_id string, page int, noise string, token string, before string, after string, repair string")


_NOISE = pa.schema([(c, pa.int32() if c == "page" else pa.string()) for c in ("unit_id", "case_id", "page", "noise", "token", "before", "after", "repair")])


def _word_rows(unit: str, case: str, words: list[tuple], places: list[tuple[int, int, int]], header: str, known: Mapping[str, int]) -> list[tuple]:
    """Rows of noise_rows for the words (of page_words) that aren't common. A capitalized word that stands once in the unit, and is by
    one confusion another of its uncommon words (or of its header's), is a misread name; numbers have their digits for a lexicon."""
    odd = [(n, i) for n, begin, end in places for i in range(begin, end) if (w := words[i])[2] or not w[3] and len(w[1]) >= 3]
    if not odd:
        return []
    own = Counter([w[1] for w in words if not w[3]])
    own.update(w.lower() for w in re.findall(r"[^\W\d_]+", header) if w.lower() not in known)
    names = nearest_names({w[1] for _, i in odd if not (w := words[i])[2] and w[0][0].isupper() and own[w[1]] == 1}, {w: n for w, n in own.items() if w not in known})
    out = []
    for page, i in odd:
        text, w, sure, _ = words[i]
        before = words[i - 1][1] if i else None
        after = words[i + 1][1] if i + 1 < len(words) else None
        noise, repair = "!" if sure else "?", None
        if sure and is_number(text):
            noise, repair = "ocr", text.translate(str.maketrans("OolI", "0011"))
        elif w in names and not sure and text[0].isupper():
            noise, repair = "ocr", names[w]
        out.append((unit, case, page, noise, text, before, after, repair))
    return out


def pair_counts(units: DataFrame, asked: DataFrame) -> DataFrame:
    """first, second, n: how often the pairs of words `asked` (first, second) stand in the pages' texts.

    A bit map of fixed size, made of the asked pairs' checksums, tells where a text is read which pairs nobody asks for; the
    others are counted for each batch, and an exact join drops those that came through by chance.
    """
    spark = units.sparkSession
    place = F.pmod(F.crc32("first") * PAIR_STEP + F.crc32("second"), F.lit(PAIR_BITS)).cast("int")
    bits = np.zeros(PAIR_BITS, dtype=bool)
    places = asked.select(place.alias("p")).distinct().toPandas()["p"].to_numpy()  # numbers below PAIR_BITS
    bits[places] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, last = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool), PAIR_BITS - 1
        for batch in batches:
            seen: Counter[tuple[bytes, bytes]] = Counter()
            for text in pc.list_flatten(batch.column(0)).to_pylist():
                words = _letter_words(text) if text else ()
                if len(words) > 1:
                    s = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words))
                    hits = there[(s[:-1] * PAIR_STEP + s[1:]) & last].nonzero()[0].tolist()
                    seen.update([(words[i], words[i + 1]) for i in hits])
            yield _batch([(a.decode(), b.decode(), n) for (a, b), n in seen.items()], _PAIRS)

    found = _unit_rows(units).select("texts").mapInArrow(count, "first string, second string, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n"))
    return found.join(asked.select("first", "second").distinct(), ["first", "second"], "left_semi")


_PAIRS = pa.schema([("first", pa.string()), ("second", pa.string()), ("n", pa.int64())])
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def _letter_words(text: str) -> list[bytes]:
    """What `[^\\W\\d_]+` finds in the text in lower case, in UTF-8."""
    text = text.lower()
    if not text.isascii():
        others = {c: " " for c in set(text) if c > "\x7f" and (c.isdecimal() or not c.isalnum())}
        if len(others) > 32:
            text = text.translate(str.maketrans(others))
        else:
            for c in others:
                text = text.replace(c, " ")
    return text.encode().translate(_LETTERS).split()


#: What a unit of cost takes from a word's score: a repair of the highest cost needs a word TIMES as frequent.
COST_WEIGHT = math.log(TIMES) / MOST_COST


def judged(units: DataFrame, rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """noise_rows with each doubtful word decided: those that are misreadings become ocr with their repair, the others fall away.

    The words are joined to what they may be misreadings of. Each of these, and the word as it stands unless it bears signs, is
    scored by its frequency, how often it stands between the same two words elsewhere in the corpus, and what the misreading
    costs; the best is taken, of equal ones the cheapest, most frequent, first in the alphabet.
    """
    doubt = rows.filter(F.col("noise").isin("?", "!")).withColumn("word", F.lower("token"))
    counts = doubt.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") >= doubt.select(F.count(F.lit(1))).scalar() * F.lit(0.01)).select("word")
    left, right = salted(doubt.drop("repair"), lexicon.misread.withColumnRenamed("token", "word"), hot, "word", F.struct("unit_id", "page"))
    read = left.join(right, ["word", "salt"]).drop("salt")
    itself = F.when(F.col("noise") == "?", F.array(F.struct(F.lit(0.0).alias("cost"), (-F.col("n")).alias("count"), F.col("word").alias("word")))).otherwise(F.array().cast("array<struct<cost: double, count: bigint, word: string>>"))
    options = checkpointed(read.select("unit_id", "case_id", "page", "token", "before", "after", F.col("word").alias("as_read"), F.explode(F.concat("repairs", itself)).alias("o")).select("*", "o.cost", (-F.col("o.count")).alias("count"), F.col("o.word").alias("word")).drop("o"))
    asked = options.select(F.explode(F.array(F.struct(F.col("before").alias("first"), F.col("word").alias("second")), F.struct(F.col("word").alias("first"), F.col("after").alias("second")))).alias("p")).select("p.*").dropna().distinct()
    found = checkpointed(pair_counts(units, checkpointed(asked)))
    options = options.join(found.select(F.col("first").alias("before"), F.col("second").alias("word"), F.col("n").alias("n_before")), ["before", "word"], "left")
    options = options.join(found.select(F.col("first").alias("word"), F.col("second").alias("after"), F.col("n").alias("n_after")), ["word", "after"], "left")
    here = F.when(F.col("word") == F.col("as_read"), 1).otherwise(0)  # the place itself
    beside = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0)) - here, F.lit(0)))
    score = F.log(F.greatest("count", F.lit(1))) + beside("n_before") + beside("n_after") - COST_WEIGHT * F.col("cost")
    best = options.groupBy("unit_id", "case_id", "page", "token", "before", "after", "as_read").agg(F.min(F.struct(F.round(-score, 9).alias("s"), (-F.col("cost")).alias("dear"), (-F.col("count")).alias("count"), "word")).alias("b"))
    chosen = best.filter(F.col("b.word") != F.col("as_read")).select("unit_id", "case_id", "page", F.lit("ocr").alias("noise"), "token", "before", "after", F.col("b.word").alias("repair"))
    return rows.filter(~F.col("noise").isin("?", "!")).unionByName(chosen)


def page_noise(units: DataFrame) -> DataFrame:
    """case_id, page, noise (hyphen, ocr, header, pageno): what is on each page of a case, once.

    units: unit_id, case_id, header, raw_pages map<int, string>, pages array<struct<page, text>> (for its part markers). Null
    maps, null and blank pages have no noise; a unit delivered twice or a page in two units counts once. Units are read row by
    row; what is shuffled are word counts, words that aren't common, the result, and where not all common words are broadcast once the
    units themselves.
    """
    lexicon = Lexicon(units)
    rows = checkpointed(noise_rows(units, lexicon))
    return judged(units, rows, lexicon).select("case_id", "page", "noise").distinct()


def chosen_repairs(found: DataFrame) -> DataFrame:
    """unit_id, repairs map<token, word> of judged rows: of a token's repairs in a unit the most frequent, then the first."""
    counted = found.filter((F.col("noise") == "ocr") & F.col("repair").isNotNull()).groupBy("unit_id", "token", "repair").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("unit_id", "token").agg(F.min(F.struct((-F.col("n")).alias("n"), "repair")).alias("b"))
    return best.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("b.repair").alias("word")))).alias("repairs"))


def _as_written(token: str, word: str) -> str:
    return word.upper() if token.isupper() and len(token) > 1 else word[:1].upper() + word[1:] if token[:1].isupper() or token[:1].isdigit() and len(token) > 1 and token[1:2].isupper() else word


def paragraphs(pages: list[Page], broken: list, repairs: dict[str, str]) -> list[tuple[int, bool, str]]:
    """(page on which it begins, whether it may continue one of the page before, text) of the paragraphs of consecutive pages."""
    at = {(b.page, b.line): (b, noise) for b, noise in broken}
    width = max((len(x) for p in pages for x in p.body), default=0)
    out: list[tuple[int, bool, str]] = []
    text, begun, leading, joint, last = "", None, False, "", ""

    def close() -> None:
        nonlocal text, begun
        if text.strip():
            out.append((begun, leading, text.strip()))
        text, begun = "", None

    for k, page in enumerate(pages):
        fresh = True
        for i, line in enumerate(page.body):
            full = line.strip()
            if not full:
                if not fresh or text[-1:] in ".!?…。！？।؟\"”»":
                    close()
                continue
            heading = fold_misread(full) in page.headings | HEADINGS
            ended = last.rstrip("\"'”’»」』)） ")[-1:] in set(".!?…。！？।؟") and len(last) < 0.8 * width
            if text and not joint and (heading or ended):
                close()
            if begun is None:
                begun, leading = page.page, k == 0 and fresh and not heading
            b = at.get((page.page, i))
            body = full[:-1] if b and b[1] else full
            glue = "" if joint == "whole" or not text or re.match(r"[぀-ヿ一-鿿]", body) and re.search(r"[぀-ヿ一-鿿。、，！？」』）]$", text) else " "
            text += glue + body
            joint = "whole" if b else ""
            last, fresh = full, False
            if heading:
                close()
    close()
    if repairs:
        keys = "|".join(re.escape(t) for t in sorted(repairs, key=len, reverse=True))
        swap = re.compile(rf"(?<![A-Za-zÀ-ɏ0-9†])(?:{keys})(?![A-Za-zÀ-ɏ0-9†])")
        out = [(p, c, swap.sub(lambda m: _as_written(m[0], repairs[m[0]]), t)) for p, c, t in out]
    return out


_MENDED = pa.schema([(c, pa.int32() if c in ("page", "para_no") else pa.string()) for c in ("case_id", "page", "para_no", "role", "text")])


def case_paragraphs(units: DataFrame) -> DataFrame:
    """case_id, page, para_no, text: each case's text once, as paragraphs in order of (page, para_no), repaired.

    A paragraph has the page on which it begins and runs over page ends. Of a page that two units share, the later unit gives
    the paragraphs that begin on it, but for one that the earlier unit carries over from the page before.
    """
    lexicon = Lexicon(units)
    repairs = checkpointed(chosen_repairs(judged(units, checkpointed(noise_rows(units, lexicon)), lexicon)))
    rows = _known_rows(units, lexicon).join(repairs, "unit_id", "left").select(*_UNIT, "repairs", "rare")
    common, running = lexicon.common, lexicon.running

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in _tuples(batch):
                i, n = _place(row[0])
                pages, ends = _read(row[:7], _running(row[8], running.value))
                broken = judged_breaks(pages, ends, _known(row[8], common.value))
                done = paragraphs(pages, broken, dict(row[7]) if row[7] is not None else {})
                numbers: Counter[int] = Counter()
                reached = {p for p, _, _ in done}
                for page, leading, text in done:
                    shared_last = i < n and len(pages) > 1 and page == pages[-1].page
                    numbers[page] += 1
                    if not shared_last:
                        out.append((row[1], page, numbers[page], "lead" if leading and i > 1 and numbers[page] == 1 else "own", text))
                if i < n and len(pages) > 1 and done:
                    tail = pages[-1]
                    first_own = next((t for p, _, t in done if p == tail.page), None)
                    head = next((x.strip() for x in tail.body if x.strip()), "")
                    if head and (tail.page not in reached or first_own is not None and not first_own.startswith(head[:10])):
                        out.append((row[1], tail.page, 1, "carried", ""))
            yield _batch(out, _MENDED)

    made = rows.mapInArrow(mend, "case_id string, page int, para_no int, role string, text string")
    made = checkpointed(made.groupBy("case_id", "page", "para_no", "role").agg(F.max("text").alias("text")))
    carried = made.filter(F.col("role") == "carried").select("case_id", "page", "para_no", F.lit("lead").alias("role"))
    kept = made.filter(F.col("role") != "carried").join(carried, ["case_id", "page", "para_no", "role"], "left_anti")
    order = Window.partitionBy("case_id", "page").orderBy("para_no", "role")
    return kept.select("case_id", "page", F.row_number().over(order).alias("para_no"), "text")
