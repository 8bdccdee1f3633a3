"""Queries p7, p8 and p9 over the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.byte_bpe import TOKENIZERS, ids_text, token_count, token_ids
from docketry.llm.lookalikes import alike, consistent_form, look_classes
from docketry.llm.packing import pack, pieces
from docketry.sources.tables import checkpointed, table

CAPACITY = 2048


def p7_ids(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k; empty for an empty and for a null text."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", token_ids(spark, F.col("text"), tokenizers).alias("ids"))


def p7_round_trip(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Ids of all documents decoded again: counts of texts, of ids and of texts that came back different (none)."""
    ids = table(spark, d, "documents").select("text", token_ids(spark, F.col("text"), tokenizers).alias("ids"))
    back = ids.select("text", F.size("ids").alias("n"), ids_text(spark, F.col("ids"), tokenizers).alias("again"))
    return back.agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_ids"), F.count_if(F.coalesce(F.col("text"), F.lit("")) != F.col("again")).alias("n_different"))


def p8_containers(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The piece or pieces of every document's text, and the container of 2,048 tokens that each lies in.

    The sizes (three numbers a document) are kept in the shared checkpoint folder, as they serve twice: for the histogram
    and for the assignment.
    """
    sizes = table(spark, d, "documents").select("doc_id", token_count(spark, F.col("text"), tokenizers).alias("n_tokens"))
    return pack(checkpointed(pieces(sizes, CAPACITY)), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them, the largest content, and the share of room used."""
    each = p8_containers(spark, d).filter(F.col("n_tokens") > 0).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"), F.round(F.sum("n") / F.count(F.lit(1)) / CAPACITY, 6).alias("filled"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts look the same but aren't equal character by character."""
    return alike(checkpointed(look_classes(table(spark, d, "documents"))))


def p9_form(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in the one form of all texts that look like it; null for null."""
    return table(spark, d, "documents").select("doc_id", consistent_form(F.col("text")).alias("form"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document with a visible character: the class of its look (the smallest id in it), and its own text's hash."""
    rows = checkpointed(look_classes(table(spark, d, "documents")))
    first = rows.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_alike"))
    return rows.join(first, "look").select("doc_id", "class_id", "n_alike", F.hex("raw").alias("text_hash"))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_form": p9_form, "p9_classes": p9_classes}
ORACLES: dict[str, str] = {}
