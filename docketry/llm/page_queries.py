"""Query p4: noise on scanned pages, and the repaired text of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.page_repair import case_paragraphs, page_noise
from docketry.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each page of each case with each kind of noise on it."""
    return page_noise(table(spark, d, "units"))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of each case, in order of page and para_no."""
    return case_paragraphs(table(spark, d, "units"))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text}
ORACLES: dict[str, str] = {}
