"""Query p5: hand-typed citations and the entries of canons that they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.canonical import mapped_rows
from docketry.sources.tables import table


def _typed(spark: SparkSession, d: str) -> DataFrame:
    mentions, records = table(spark, d, "mentions"), table(spark, d, "records")
    m = mentions.filter(F.col("canon_id").startswith("other:")).select(F.lit("mentions").alias("tbl"), F.col("mention_id").alias("row_key"), F.col("display").alias("value"))
    return m.unionByName(records.select(F.lit("records").alias("tbl"), F.col("id").alias("row_key"), F.col("citation").alias("value")))


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every row of mentions with a fallback id and of records that has a value, with the entry that it means; null: unmatched."""
    return mapped_rows(_typed(spark, d), table(spark, d, "canons"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose value isn't a display of canons but means one."""
    canons = table(spark, d, "canons")
    rows = _typed(spark, d).join(canons.select(F.col("display").alias("value")), "value", "left_anti")
    return mapped_rows(rows, canons).filter(F.col("canon_id").isNotNull()).select("tbl", "row_key", "canon_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values without an entry and how many rows have each."""
    return p5_mapped(spark, d).filter(F.col("canon_id").isNull()).groupBy("tbl", "value").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p5_found": p5_found, "p5_mapped": p5_mapped, "p5_unmatched": p5_unmatched}
ORACLES: dict[str, str] = {}
