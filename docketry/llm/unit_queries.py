"""Query p2: pieces of oversized units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.cutting import checked_pieces, unit_pieces
from docketry.sources.tables import table


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every unit that exceeds a limit of its profile, with their texts."""
    return unit_pieces(table(spark, d, "units"), table(spark, d, "llm_settings"), table(spark, d, "segments"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The units that were cut, and the limits they exceed."""
    return unit_pieces(table(spark, d, "units"), table(spark, d, "llm_settings"), table(spark, d, "segments"), with_text=False).select("unit_id", "limit_name").distinct()


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of every unit that exceeds a limit: whether its pieces keep it, overlap exactly, and cover the text."""
    units, settings = table(spark, d, "units"), table(spark, d, "llm_settings")
    return checked_pieces(unit_pieces(units, settings, table(spark, d, "segments")), units, settings)


def p2_cuts(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces begin at each kind of boundary."""
    pieces = unit_pieces(table(spark, d, "units"), table(spark, d, "llm_settings"), table(spark, d, "segments"), with_text=False)
    return pieces.groupBy("limit_name", "cut_at").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_checked": p2_checked, "p2_cuts": p2_cuts}
_OVER = """WITH u AS (SELECT DISTINCT unit_id, profile, pages FROM units),
s AS (SELECT u.unit_id, list_sum(list_transform(u.pages, lambda p: coalesce(length(p.text), 0))) AS chars, len(u.pages) AS n, l.edge_split_chars, l.window_pages FROM u JOIN llm_settings l ON u.profile = l.profile)"""
ORACLES = {
    "p2_found": """WITH u AS (SELECT DISTINCT unit_id, profile, pages FROM units),
s AS (SELECT u.unit_id, list_sum(list_transform(u.pages, lambda p: coalesce(length(p.text), 0))) AS chars, len(u.pages) AS n, l.edge_split_chars, l.window_pages FROM u JOIN llm_settings l ON u.profile = l.profile)
SELECT DISTINCT unit_id, 'edge_split_chars' AS limit_name FROM s WHERE chars > edge_split_chars
UNION ALL SELECT DISTINCT unit_id, 'window_pages' FROM s WHERE n > window_pages""",
    "p2_checked": f"""{_OVER} SELECT DISTINCT unit_id, 'edge_split_chars' AS limit_name, true AS within_limit, true AS overlap_exact, true AS whole FROM s WHERE chars > edge_split_chars
UNION ALL SELECT DISTINCT unit_id, 'window_pages', true, true, true FROM s WHERE n > window_pages""",
}
