"""Cutting oversized units at natural boundaries, with an overlap."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.skew import salted
from docketry.sources.tables import checkpointed

# Kinds of places to cut, strongest first. What follows the last is no natural boundary.
KINDS = ("segment", "page", "paragraph", "sentence")
#: A cut is sought within this share of a piece's length on either side of its target before farther ones are taken.
NEAR = 0.25

_PART = re.compile(r"\n?<<<PART BEGINS: [^\n]*>>>\n")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*(?=\S)|(?<=[.!?。！？।؟])\n(?=\S)")
_SENTENCE = re.compile(r"[.!?…؟।][\"'”’»)\]]*\s+(?=[^\s\d])|[。！？][」』”’）)\]]*\s*(?=\S)")


def marked_offset(text: str, at: int) -> int:
    """Where the character `at` of a raw page is in the page with part markers; of a place with a marker, the marker's begin."""
    before = 0
    for m in _PART.finditer(text):
        if m.start() - before >= at:
            break
        before += m.end() - m.start()
    return at + before


def boundaries(pages: list[str], segments: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """(offset, strength) of all natural boundaries inside the pages' joined text, by offset; 0 is the strongest kind.

    `segments` has the start_char of the segments that begin on each page, offsets in the raw page; they are mapped over the part
    markers in the text. A marker for which there is no segment shows that one begins there all the same.
    """
    found: dict[int, int] = {}
    base = 0
    for k, text in enumerate(pages):
        starts = [marked_offset(text, at) for at in segments[k]] if segments else []
        starts += [m.start() for m in _PART.finditer(text)]
        for strength, places in ((0, [at for at in starts if at <= len(text)]), (1, (0,)), (2, (m.end() for m in _PARAGRAPH.finditer(text))), (3, (m.end() for m in _SENTENCE.finditer(text)))):
            for at in places:
                found[base + at] = min(found.get(base + at, strength), strength)
        base += len(text)
    found.pop(0, None)
    found.pop(base, None)
    return sorted(found.items())


def _hard(text: str, low: int, high: int) -> int:
    """Where to cut when there is no boundary: behind the last blank, else at `high`, never before a combining mark."""
    at = max(text.rfind(" ", low, high), text.rfind("\n", low, high)) + 1
    if at <= low:
        at = high
        while at > low + 1 and at < len(text) and unicodedata.combining(text[at]):
            at -= 1
    return at


def balanced_cuts(text: str, marks: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the start) of pieces of at most `limit` characters that together are the text.

    From the second on a piece starts `overlap` characters before its cut (or where the piece before starts, if that is
    later). The least count of pieces is tried first: targets at equal distances, each moved to the strongest boundary near
    it, else to the nearest that leaves all limits kept; if a target has none, there is one piece more. Only where no
    boundary lies within a piece's reach at all is it cut at a blank, or failing that anywhere.
    """
    size = len(text)
    overlap = max(0, min(overlap, limit - 1))
    at, strength = [m[0] for m in marks], [m[1] for m in marks]
    step = limit - overlap
    count = 1 if size <= limit else 1 + -(-(size - limit) // step)
    least = count
    while True:
        pieces, start, cut, kind = [], 0, 0, "start"
        for i in range(1, count):
            reach = start + limit
            if reach >= size:
                break
            low = max(cut + 1, size - (count - i) * step)
            target = cut + (size - cut) // (count - i + 1)
            a, b, any_from = bisect.bisect_left(at, low), bisect.bisect_right(at, reach), bisect.bisect_right(at, cut)
            radius = max(1, int(NEAR * (target - cut)))
            near = [j for j in range(a, b) if abs(at[j] - target) <= radius]
            if near:
                j = min(near, key=lambda j: (strength[j], abs(at[j] - target)))
            elif a < b:
                j = min(range(a, b), key=lambda j: abs(at[j] - target))
            elif any_from < b and count < 4 * least + 8:
                break
            else:
                j = b - 1 if any_from < b else None
            end = at[j] if j is not None else _hard(text, low if low <= reach else cut + 1, reach)
            pieces.append((start, end, kind))
            kind = KINDS[strength[j]] if j is not None else "none"
            start, cut = max(start, end - overlap), end
        if size - start <= limit:
            return [*pieces, (start, size, kind)]
        count += 1


def page_windows(n_pages: int, width: int, strong: set[int]) -> list[tuple[int, int]]:
    """(first, last) page numbers, from 0, of windows of at most `width` pages, each starting with the last page of the one
    before. As few windows as possible, with targets at equal steps, each moved to the nearest page at whose top a segment begins
    (`strong`) within NEAR of a step, or else left. Windows of one page can't overlap."""
    if n_pages <= width:
        return [(0, n_pages - 1)]
    if width <= 1:
        return [(i, i) for i in range(n_pages)]
    count = -(-(n_pages - 1) // (width - 1))
    radius = max(1, int(NEAR * (width - 1)))
    out, first = [], 0
    for i in range(1, count):
        target = first + -(-(n_pages - 1 - first) // (count - i + 1))
        low, high = max(first + 1, n_pages - 1 - (count - i) * (width - 1)), first + width - 1
        near = [p for p in range(target - radius, target + radius + 1) if low <= p <= high]
        last = min(near, key=lambda p: (p not in strong, abs(p - target)))
        out.append((first, last))
        first = last
    return [*out, (first, n_pages - 1)]


COLUMNS = "unit_id string, limit_name string, piece_no int, n_pieces int, start_char int, end_char int, first_page int, last_page int, cut_at string"


def cut_unit(pages: list[tuple[int, str]], max_chars: int | None, max_pages: int | None, overlap: int, segments: dict[int, list[int]] | None = None) -> Iterator[tuple]:
    """Rows of COLUMNS without unit_id, then the piece's text, for each limit that the unit exceeds. `segments` has the start_char of
    the segments that begin on a page, by its number."""
    by_page = [(segments or {}).get(n, []) for n, _ in pages]
    texts = [t for _, t in pages]
    whole = "".join(texts)
    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(t))
    page_at = lambda i: pages[max(0, min(bisect.bisect_right(starts, i) - 1, len(pages) - 1))][0]
    if max_chars and len(whole) > max_chars:
        cuts = balanced_cuts(whole, boundaries(texts, by_page), max_chars, overlap)
        for i, (a, b, kind) in enumerate(cuts):
            yield "edge_split_chars", i, len(cuts), a, b, page_at(a), page_at(max(a, b - 1)), kind, whole[a:b]
    if max_pages and len(pages) > max_pages:
        windows = page_windows(len(pages), max_pages, {i for i, t in enumerate(texts) if _PART.match(t) or 0 in by_page[i]})
        for i, (a, b) in enumerate(windows):
            yield "window_pages", i, len(windows), starts[a], starts[b + 1], pages[a][0], pages[b][0], "page" if i else "start", whole[starts[a] : starts[b + 1]]


def segment_starts(units: DataFrame, segments: DataFrame) -> DataFrame:
    """of_unit, starts (array<struct<page, at>>): where segments of the unit's case begin, for each unit with any.

    Only ids and numbers are read and moved. A case with very many units is split over salts; its starts are as many as its
    document has parts. Segments without a case, page or offset, and units without a case, are left out.
    """
    own = units.select(F.col("unit_id").alias("of_unit"), "case_id").filter(F.col("case_id").isNotNull()).distinct()
    starts = segments.select("case_id", F.col("start_page").alias("page"), F.col("start_char").alias("at")).dropna().groupBy("case_id").agg(F.collect_set(F.struct("page", "at")).alias("starts"))
    n = own.select(F.count(F.lit(1))).scalar()
    hot = own.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n * F.lit(0.01)).select("case_id")
    left, right = salted(own, starts, hot, "case_id", F.col("of_unit"))
    return left.join(right, ["case_id", "salt"]).groupBy("of_unit").agg(F.flatten(F.collect_set("starts")).alias("starts"))


def unit_pieces(units: DataFrame, settings: DataFrame, segments: DataFrame, *, with_text: bool = True) -> DataFrame:
    """The pieces of each unit that exceeds edge_split_chars or window_pages of its profile, for each limit exceeded.

    units: unit_id, case_id, profile, pages array<struct<page, text>>. settings: profile, edge_split_chars, window_pages,
    overlap_chars; it doesn't grow, and Spark broadcasts it where its size is under the session's threshold. segments: case_id,
    start_page, start_char, the strongest places to cut. Pages are taken in order of their number (ties: as they stand), null
    texts as empty. Offsets are in the pages' joined text, part markers included. Joined and cut again, the pieces less their
    overlaps are the text. Units with null pages, or whose profile is missing or has null or non-positive limits, exceed
    nothing; a unit of no known case is cut at the other boundaries. A unit delivered again gives its pieces once.

    The starts of segments are brought together by unit first, without texts. The texts are joined to them by unit: where they
    lie, if the starts are under the session's broadcast threshold, else in one shuffle by an even key.
    """
    rows = units.select("unit_id", "profile", "pages").filter(F.col("pages").isNotNull()).join(settings.select("profile", "edge_split_chars", "window_pages", "overlap_chars"), "profile")
    chars = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(F.length(p["text"]), F.lit(0)))
    over = ((F.col("edge_split_chars") > 0) & (chars > F.col("edge_split_chars"))) | ((F.col("window_pages") > 0) & (F.size("pages") > F.col("window_pages")))
    rows = rows.filter(over).select("unit_id", F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"))).alias("pages"), "edge_split_chars", "window_pages", "overlap_chars")
    starts = checkpointed(segment_starts(units, segments))
    rows = rows.join(starts, F.col("unit_id") == F.col("of_unit"), "left").drop("of_unit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: 0 if x is None or x != x else int(x)
        for batch in batches:
            out = []
            for unit, pages, chars_limit, pages_limit, overlap, begin in batch.itertuples(index=False, name=None):
                ordered = sorted(((number(p["page"]), p["text"] or "") for p in pages if p is not None), key=lambda p: p[0])
                own: dict[int, list[int]] = {}
                for x in begin if begin is not None else ():
                    own.setdefault(x["page"], []).append(x["at"])
                for row in cut_unit(ordered, number(chars_limit), number(pages_limit), number(overlap), own):
                    out.append((unit, *(row if with_text else row[:-1])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in (COLUMNS + ", text string" * with_text).split(", ")])

    pieces = rows.mapInPandas(cut, COLUMNS + ", text string" * with_text)
    return pieces.dropDuplicates(["unit_id", "limit_name", "piece_no"])


def checked_pieces(pieces: DataFrame, units: DataFrame, settings: DataFrame) -> DataFrame:
    """unit_id, limit_name, within_limit, overlap_exact, whole: whether the pieces (with texts) of each cut unit are within its
    profile's limit, start with the end of the piece before, and cover the unit's text from its begin to its end."""
    order = Window.partitionBy("unit_id", "limit_name").orderBy("piece_no")
    p = pieces.withColumns({"end_before": F.lag("end_char").over(order), "start_before": F.lag("start_char").over(order), "page_before": F.lag("last_page").over(order)})
    size = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0)))
    pages = F.transform("pages", lambda x: x["page"])
    about = units.filter(F.col("pages").isNotNull()).select("unit_id", "profile", size.alias("size"), pages.alias("page_numbers")).distinct().join(settings, "profile")
    p = p.join(about, "unit_id")
    chars = F.col("limit_name") == "edge_split_chars"
    n_pages = F.size(F.filter("page_numbers", lambda x: (x >= F.col("first_page")) & (x <= F.col("last_page"))))
    within = F.when(chars, F.length("text") <= F.col("edge_split_chars")).otherwise(n_pages <= F.col("window_pages"))
    due = F.greatest(F.col("end_before") - F.least("overlap_chars", F.col("edge_split_chars") - 1), F.col("start_before"))
    exact = F.col("end_before").isNull() | F.when(chars, F.col("start_char") == due).otherwise((F.col("window_pages") <= 1) | (F.col("first_page") == F.col("page_before")))
    joined = F.col("start_char") <= F.coalesce("end_before", F.lit(0))
    return p.groupBy("unit_id", "limit_name").agg(
        F.bool_and(within).alias("within_limit"), F.bool_and(exact).alias("overlap_exact"),
        (F.bool_and(joined & (F.length("text") == F.col("end_char") - F.col("start_char"))) & (F.min("start_char") == 0) & (F.max("end_char") == F.max("size"))).alias("whole"),
    )
