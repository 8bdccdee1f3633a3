"""Extracted items from stored replies of a language model: parsed, validated, verified, merged and given ids.

Replies come as a table (unit_id, stage, text, finish_reason); nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import clamp_float, json_object, judge_id, slug, squash, surname
from docketry.operators.evaluation import assigned_ids, deduplicated, valid_edges, valid_nodes
from docketry.operators.quotes import checked_quotes, located, verified_items

_EVIDENCE = "evidence: array<struct<page: string, quote: string>>"
NODES = f"struct<nodes: array<struct<type: string, label: string, summary: string, part: string, author: string, confidence: string, {_EVIDENCE}, attrs: map<string, string>>>>"
EDGES = f"struct<edges: array<struct<source: string, target: string, relation: string, stance: string, basis: string, part: string, confidence: string, {_EVIDENCE}, attrs: map<string, string>>>>"
# What a reply may call a treatment, and the confidence of doctrines and authors.
TREATMENTS = {"follows": "FOLLOWS", "distinguishes": "DISTINGUISHES", "overrules": "OVERRULES"}
META_CONFIDENCE, MOST_DOCTRINES = 0.8, 4


def _items(replies: DataFrame, units: DataFrame, stage: str, schema: str) -> DataFrame:
    """case_id, unit_id, pos and the fields of each item in the whole replies of a stage; replies cut off or without JSON give none."""
    whole = replies.filter((F.col("stage") == stage) & (F.coalesce("finish_reason", F.lit("stop")) != "length"))
    parsed = whole.select("unit_id", F.from_json(json_object(F.col("text")), schema)[stage].alias("items"))
    rows = parsed.select("unit_id", F.posexplode("items").alias("pos", "i")).select("unit_id", "pos", "i.*")
    return rows.join(units.select("unit_id", "case_id", "repeated_page").distinct(), "unit_id")


def _quoted(c: str = "evidence"):
    return F.filter(F.coalesce(c, F.array().cast("array<struct<page: string, quote: string>>")), lambda e: F.trim(F.coalesce(e["quote"], F.lit(""))) != "")


def node_items(replies: DataFrame, units: DataFrame) -> DataFrame:
    """Every node item with `reason`: why it is rejected, or null."""
    rows = _items(replies, units, "nodes", NODES).withColumns({"evidence": _quoted(), "kind": F.col("attrs")["kind"], "cite_string": F.col("attrs")["cite_string"], "doctrine": F.col("attrs")["doctrine"]})
    return valid_nodes(rows.withColumn("n_quotes", F.size("evidence")))


def _verified(items: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Items with provenance, confidence, evidence_strength and evidence (verified where any is), by V3's rules."""
    number = clamp_float(F.col("confidence"), 0.7)
    rows = items.select(*key, "case_id", number.alias("confidence"), F.explode("evidence").alias("e")).select(*key, "case_id", "confidence", F.col("e.page").try_cast("int").alias("page"), "e.quote")
    rows = rows.withColumn("item_key", F.concat_ws("\u0001", *key))
    found = located(rows, pages)
    grade = verified_items(found, "item_key")
    fact = F.struct(F.coalesce("found_page", "page").alias("page"), "quote", F.col("found_page").isNotNull().alias("verified"), F.col("found_start").cast("int").alias("start"), F.col("found_end").cast("int").alias("end"))
    facts = found.groupBy("item_key").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    kept = F.when(F.exists("facts", lambda f: f["verified"]), F.filter("facts", lambda f: f["verified"])).otherwise(F.col("facts"))
    out = items.drop("confidence", "evidence", "provenance").withColumn("item_key", F.concat_ws("\u0001", *key)).join(grade, "item_key").join(facts, "item_key")
    return out.withColumn("evidence", kept).drop("item_key", "facts", "n_quotes", "n_verified")


def extracted_nodes(replies: DataFrame, units: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, id, unit_id, type, label, summary, part, author, kind, cite_string, doctrine, provenance, confidence,
    evidence_strength, evidence of the accepted nodes of each case.

    units: unit_id, case_id, repeated_page. Items all of whose verified evidence lies on a page that the unit before had are left
    out; of items that are the same (evaluation.deduplicated) the first stays, with the highest confidence, and is llm if any is.
    """
    good = node_items(replies, units).filter(F.col("reason").isNull()).drop("reason", "attrs", "n_quotes")
    rows = _verified(good, pages, ["unit_id", "pos"])
    again = F.col("repeated_page").isNotNull() & (F.col("provenance") == "llm") & F.forall("evidence", lambda e: e["page"] == F.col("repeated_page"))
    rows = rows.filter(~F.coalesce(again, F.lit(False))).withColumn("item", F.row_number().over(Window.partitionBy("case_id").orderBy("unit_id", "pos")))
    spans = F.transform(F.filter("evidence", lambda e: e["verified"]), lambda e: F.named_struct(F.lit("start"), e["start"], F.lit("end"), e["end"]))
    into = deduplicated(rows.select("case_id", "item", "type", "label", spans.alias("spans")))
    merged = rows.select("case_id", "item", "provenance", "confidence").join(into, ["case_id", "item"]).groupBy("case_id", F.col("into").alias("item")).agg(F.when(F.max(F.col("provenance") == "llm"), "llm").otherwise("unverified").alias("provenance"), F.max("confidence").alias("confidence"))
    out = rows.drop("provenance", "confidence").join(merged, ["case_id", "item"])
    return assigned_ids(out, "item").drop("item", "pos", "repeated_page")


def extracted_edges(replies: DataFrame, units: DataFrame, nodes: DataFrame, pages: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects) of the edge items: checked against the nodes of their unit's case and the allowed signatures, verified,
    and of equal (source, relation, target) the first. An edge without a part takes its source's."""
    items = _items(replies, units, "edges", EDGES).withColumn("evidence", _quoted())
    known = items.select("unit_id", "case_id").distinct().join(nodes.select("case_id", "id", "type", F.col("part").alias("source_part")), "case_id")
    checked = valid_edges(items, known, signatures)
    bad = checked.filter(F.col("reason").isNotNull()).select("unit_id", "pos", "reason")
    good = checked.filter(F.col("reason").isNull() & (F.size("evidence") > 0)).drop("reason", "attrs")
    first = F.row_number().over(Window.partitionBy("case_id", "source", "relation", "target").orderBy("unit_id", "pos"))
    rows = _verified(good.withColumn("k", first).filter("k = 1").drop("k"), pages, ["unit_id", "pos"])
    rows = rows.join(known.select("unit_id", F.col("id").alias("source"), "source_part"), ["unit_id", "source"], "left")
    return rows.withColumn("part", F.coalesce("part", "source_part")).drop("source_part", "pos", "repeated_page"), bad


def accepted_treatments(replies: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped counts by reason) of replies on how one case treats another: source, target, text.

    A reply counts if it names one of three treatments and its quote is on the stated page, or else any page, of the source.
    """
    schema = "struct<treatment: string, quote: string, page: string, confidence: string>"
    rows = replies.select("source", "target", F.from_json(json_object(F.col("text")), schema).alias("r")).select("source", "target", F.lower(F.trim("r.treatment")).alias("treatment"), F.col("r.quote").alias("quote"), F.col("r.page").try_cast("int").alias("page"), clamp_float(F.col("r.confidence"), 0.5).alias("confidence"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TREATMENTS.items() for x in kv]), F.coalesce("treatment", F.lit("")))
    checked = checked_quotes(rows.withColumn("type", kind).withColumn("case_id", F.col("source")), pages)
    reason = F.when(F.col("type").isNull(), "treatment_cites").when(~F.col("quote_match"), "treatment_unverified_quote")
    checked = checked.withColumn("reason", reason)
    edges = checked.filter(F.col("reason").isNull()).select("type", "source", "target", "treatment", "confidence", F.col("matched_page").alias("page"), "quote")
    return edges, checked.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def accepted_case_data(replies: DataFrame, pages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped counts by reason) of replies on a case's doctrines (at most four) and author: case_id, text.

    A doctrine counts if its quote is on a page of the case; an author if so and the quote holds the author's surname.
    """
    schema = "struct<doctrines: array<struct<name: string, quote: string, page: string>>, author: struct<name: string, quote: string, page: string>>"
    rows = replies.select("case_id", F.from_json(json_object(F.col("text")), schema).alias("r"))
    d = rows.select("case_id", F.explode(F.slice("r.doctrines", 1, MOST_DOCTRINES)).alias("d")).select("case_id", F.lower(squash(F.col("d.name"))).alias("name"), "d.quote", F.col("d.page").try_cast("int").alias("page")).filter(F.coalesce("name", F.lit("")) != "")
    a = rows.select("case_id", squash(F.col("r.author.name")).alias("name"), F.col("r.author.quote").alias("quote"), F.col("r.author.page").try_cast("int").alias("page")).filter(F.coalesce("name", F.lit("")) != "")
    d, a = checked_quotes(d, pages), checked_quotes(a, pages)
    court = known.select(F.col("id").alias("case_id"), "court")
    named = F.col("quote_match") & F.contains(F.lower("quote"), F.lower(surname(F.col("name"))))
    edge = lambda kind, target: [F.lit(kind).alias("type"), F.col("case_id").alias("source"), target.alias("target"), F.lit(META_CONFIDENCE).alias("confidence"), F.col("matched_page").alias("page"), "quote"]
    one = d.filter("quote_match").select(*edge("INVOKES_DOCTRINE", F.concat(F.lit("doctrine:"), slug(F.col("name")))))
    two = a.filter(named).join(court, "case_id", "left").select(*edge("AUTHORED_BY", judge_id(F.col("court"), F.col("name"))))
    lost = d.filter("NOT quote_match").select(F.lit("doctrine_unverified_quote").alias("reason")).unionByName(a.filter(~F.coalesce(named, F.lit(False))).select(F.lit("author_unverified").alias("reason")))
    return one.unionByName(two), lost.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
