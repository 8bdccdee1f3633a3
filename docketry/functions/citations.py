"""Citations in free text to canonical ids, as one column expression without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import squash

# The citation forms, in the order in which they are tried. Each is searched anywhere in the squashed text.
IMMIGRATION_DECISIONS = r"(\d+)\s*I&N\s*Dec\.?\s*(\d+)"
US_CODE = r"(\d+)\s*U\.\s*S\.\s*C\.\s*(?:A\.\s*)?§*\s*(\d+[a-z]?)"
FEDERAL_REGULATIONS = r"(\d+)\s*C\.\s*F\.\s*R\.\s*§*\s*(\d+)"
US_REPORTS = r"(\d+)\s*U\.\s*S\.\s*(\d+)"
FEDERAL_REPORTERS = r"(\d+)\s+(F\.\s?(?:2d|3d|4th)|F\.\s?Supp\.(?:\s?[23]d)?|S\.\s?Ct\.|L\.\s?Ed\.(?:\s?2d)?|Fed\.\s?Appx\.)\s*(\d+)"


def canon(c: Column) -> Column:
    """A struct of id, kind (case, statute, regulation, other) and display; null for null.

    What fits no form gets the id `other:` and a slug cut to 60 characters, which is not stripped after the cut.
    """
    s = squash(c)

    def two(pattern: str, kind: str, id_format: str, display: str) -> tuple[Column, Column]:
        v, p = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
        return s.rlike(pattern), F.struct(F.format_string(id_format, v, F.lower(p)).alias("id"), F.lit(kind).alias("kind"), F.format_string(display, v, p).alias("display"))

    v, r, p = (F.regexp_extract(s, FEDERAL_REPORTERS, i) for i in (1, 2, 3))
    reporter = F.struct(F.concat(F.regexp_replace(F.lower(r), "[^a-z0-9]+", ""), F.lit(":"), v, F.lit("_"), p).alias("id"), F.lit("case").alias("kind"), F.concat_ws(" ", v, r, p).alias("display"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)
    other = F.struct(F.concat(F.lit("other:"), slug).alias("id"), F.lit("other").alias("kind"), s.alias("display"))
    forms = [
        two(IMMIGRATION_DECISIONS, "case", "in_dec:%s_%s", "%s I&N Dec. %s"),
        two(US_CODE, "statute", "usc:%s_%s", "%s U.S.C. § %s"),
        two(FEDERAL_REGULATIONS, "regulation", "cfr:%s_%s", "%s C.F.R. Part %s"),
        two(US_REPORTS, "case", "us:%s_%s", "%s U.S. %s"),
        (s.rlike(FEDERAL_REPORTERS), reporter),
    ]
    out = other
    for test, value in reversed(forms):
        out = F.when(test, value).otherwise(out)
    return F.when(c.isNotNull(), out)


def title_section(canon_id: Column) -> Column:
    """A statute's or regulation's id as title_no, section and part; what the scheme lacks is null."""
    scheme, rest = F.substring_index(canon_id, ":", 1), F.regexp_replace(canon_id, "^[^:]*:", "")
    number = F.regexp_replace(rest, "^[^_]*_?", "")
    return F.struct(
        F.when(scheme != "ina", F.substring_index(rest, "_", 1)).alias("title_no"),
        F.when(scheme == "ina", rest).when(scheme != "cfr", number).alias("section"),
        F.when(scheme == "cfr", number).alias("part"),
    )


def cite_pattern(c: Column) -> Column:
    """A Java pattern that finds the citation with any blanks between its characters, and never inside a longer number."""
    chars = F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", ""), ""), lambda x: x != "")
    return F.concat(F.lit(r"(?<!\d)"), F.array_join(F.transform(chars, lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}])", r"\\$1")), r"\s*"), F.lit(r"(?!\d)"))
