"""Query p6: sentences of turns and of the pages of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.sentences import sentence_spans
from docketry.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of every sentence of every turn."""
    return sentence_spans(table(spark, d, "turns"), ["turn_id"])


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of every sentence of every raw page of the units; a page that two units share comes out once."""
    pages = table(spark, d, "units").select("case_id", F.explode("raw_pages").alias("page", "text"))
    return sentence_spans(pages, ["case_id", "page"])


QUERIES = {"p6_found": p6_found, "p6_pages": p6_pages}
ORACLES: dict[str, str] = {}
