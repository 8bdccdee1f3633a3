"""Statute and regulation mentions in page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sections of the one act and of the code that they became, and the patterns by name.
SECTION_TO_CODE = {"101": "1101", "208": "1158", "212": "1182", "235": "1225", "237": "1227", "239": "1229", "240": "1229a", "240A": "1229b", "240B": "1229c", "241": "1231"}
PATTERNS = {
    "usc": r"(?<![\d#])(\d+)\s*U\.\s*S\.\s*C\.\s*(?:A\.\s*)?§*\s*(\d+[a-z]?)",
    "cfr": r"(?<![\d#])(\d+)\s*C\.\s*F\.\s*R\.\s*(?:§+\s*)?(\d+)(?:\.\d+)?",
    "ina_symbol": r"\bINA\s*§+\s*(\d+[A-Z]?)",
    "ina_section": r"(?i)\bsection\s+(\d+[A-Z]?)(?:\([0-9a-zA-Z]+\))*\s+of\s+the\s+(?:Immigration\s+and\s+Nationality\s+)?Act\b",
}
CONTEXT = 60


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of all matches of a pattern without empty matches: the lengths of what lies between them and of
    the matches themselves, added up."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), 1)
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(between.alias("b"), found.alias("f"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, found: string>>").alias("out"))
    step = lambda acc, p: F.when(p["f"].isNull(), acc).otherwise(F.struct((acc["at"] + F.length(p["b"]) + F.length(p["f"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["b"])).alias("start"), p["f"].alias("found")))).alias("out")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def extract_mentions(pages: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """case_id, page, pattern, start, canon_id, kind, display, quote of all mentions that the named patterns find. The quote has 60
    characters on either side. An unknown pattern's name is an error; null texts have no mentions."""
    if unknown := [p for p in patterns if p not in PATTERNS]:
        raise ValueError(f"unknown statute patterns: {unknown}")
    crosswalk = F.create_map(*[F.lit(x) for kv in SECTION_TO_CODE.items() for x in kv])
    out = None
    for name in patterns:
        p = PATTERNS[name]
        rows = pages.filter(F.col("text").rlike(p)).select("case_id", "page", "text", F.explode(match_offsets(F.col("text"), p)).alias("m")).select("case_id", "page", "text", "m.*")
        a = F.regexp_extract("found", p, 1)
        if name in ("usc", "cfr"):
            b = F.regexp_extract("found", p, 2)
            values = [F.concat(F.lit(f"{name}:"), a, F.lit("_"), F.lower(b)), F.lit("statute" if name == "usc" else "regulation"), F.concat(a, F.lit(" U.S.C. § " if name == "usc" else " C.F.R. Part "), b)]
        else:
            section = F.upper(a)
            code = F.element_at(crosswalk, section)
            values = [F.coalesce(F.concat(F.lit("usc:8_"), F.lower(code)), F.concat(F.lit("ina:"), section)), F.lit("statute"), F.coalesce(F.concat(F.lit("8 U.S.C. § "), code), F.concat(F.lit("INA § "), section))]
        low = F.greatest(F.col("start") - CONTEXT, F.lit(0))
        quote = F.substring("text", low + 1, F.col("start") - low + F.length("found") + CONTEXT)
        part = rows.select("case_id", "page", F.lit(name).alias("pattern"), "start", values[0].alias("canon_id"), values[1].alias("kind"), values[2].alias("display"), quote.alias("quote"))
        out = part if out is None else out.unionByName(part)
    return out
