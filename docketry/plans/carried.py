"""Queries of operators for which the test tables hold no input of their own: other tables carry it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as fx
from docketry.functions.citations import cite_pattern
from docketry.operators import answers, chunking, evaluation, extraction, ledger, quotes
from docketry.operators import graph as g
from docketry.plans import sql
from docketry.plans.graph import _SMALL, all_pages, known_cases, small_graph
from docketry.sources import records
from docketry.sources.tables import shared_folder, table


def s1_records(spark: SparkSession, d: str) -> DataFrame:
    """How many lines are records, and why the others aren't: records as JSON lines, a part of them broken by their title's length."""
    r = table(spark, d, "records").select("id", "title").distinct().withColumn("n", F.length("title") % 5)
    page = F.array(F.struct(F.lit(1).alias("page"), F.lit("x").alias("text")))
    line = F.to_json(F.struct("id", F.when(F.col("n") != 1, F.col("title")).alias("title"), F.when(F.col("n") != 2, page).alias("pages")))
    good, bad = records.parsed_records(r.select(F.when(F.col("n") == 0, F.substring(line, 2, 1 << 30)).otherwise(line).alias("line"), F.lit("memory").alias("source")), "immigration")
    both = good.select(F.lit("record").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def s2_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with two files of the tables' folder, by a manifest of other content."""
    manifest = spark.createDataFrame([("llm_settings.parquet", "0" * 64), ("absent.parquet", "0" * 64)], "path string, sha256 string")
    return records.checked_manifest(spark, d, manifest).filter(F.col("problem") != "unlisted")


def s5_graph(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the small graph, written to the shared folder and read again."""
    nodes, edges = small_graph(spark, d)
    blank = [F.lit("deterministic").alias("provenance"), F.lit(1.0).alias("confidence"), F.array().cast("array<struct<page: int, quote: string>>").alias("evidence")]
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    records.write_graph(nodes.select("*", *blank), edges, path)
    return g.graph_stats(*records.read_graph(spark, path))


def s8_query(spark: SparkSession, d: str) -> DataFrame:
    """A reading query over the small graph."""
    nodes, edges = small_graph(spark, d)
    return records.read_only_sql(spark, nodes=nodes, edges=edges)("WITH e AS (SELECT type, target FROM edges) SELECT e.type, n.label, count(*) AS n FROM e JOIN nodes n ON n.id = e.target GROUP BY e.type, n.label")


def s10_runs(spark: SparkSession, d: str) -> DataFrame:
    """Turns by the run of their file's name, of which shards have a number."""
    t = table(spark, d, "turns").select("turn_id", "system", "revisions").distinct()
    name = F.concat(F.lit("file:/runs/qa_"), F.col("system"), F.when(F.col("revisions") > 0, F.concat(F.lit("_s"), F.col("revisions").cast("string"))).otherwise(""), F.lit(".jsonl"))
    return t.groupBy(records.run_of(name).alias("run")).agg(F.count(F.lit(1)).alias("n"))


def s11_cached(spark: SparkSession, d: str) -> DataFrame:
    """Which documents' texts are among those of documents with an even id, looked up as requests in a cache."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").withColumn("cache_key", records.cache_key("1", text="text"))
    cache = docs.filter(F.col("doc_id") % 2 == 0).select("cache_key", F.lit("reply").alias("text")).distinct()
    return records.cached_replies(docs.select("doc_id", "cache_key"), cache).select("doc_id", "cached")


def s15_usage(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of turns by their message's id, or for those that have none by their latency."""
    t = table(spark, d, "turns").select("turn_id", "latency_s", "input_tokens", "output_tokens", "revisions").distinct()
    usage = t.select(F.col("turn_id").alias("id"), "latency_s", "input_tokens", "output_tokens")
    messages = t.filter("revisions > 0").select("turn_id", F.col("turn_id").alias("message_id"))
    return ledger.usage_by_turn(usage, messages, t.select("turn_id", "latency_s"), 0.02)


def f7_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Whether each citation of records is found with other blanks, and behind another digit."""
    raw = table(spark, d, "records").select(F.explode("citations").alias("raw")).filter("raw IS NOT NULL").distinct()
    p = cite_pattern(F.col("raw"))
    return raw.select("raw", F.rlike(F.concat(F.lit("see "), F.regexp_replace("raw", " ", "\n "), F.lit(".")), p).alias("spaced"), F.rlike(F.concat(F.lit("9"), F.col("raw")), p).alias("inside"))


def f15_final(spark: SparkSession, d: str) -> DataFrame:
    """Answers read from replies: turns in a fenced block behind another, as bare JSON behind a sentence, or as they are."""
    t = table(spark, d, "turns").select("turn_id", F.regexp_replace("text", "[`{}]", "").alias("text")).distinct().withColumn("n", F.length("text") % 3)
    made = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.struct(F.lit("a").alias("case")), F.struct(F.lit("").alias("case"))).alias("citations")))
    fenced = F.concat(F.lit("```json\n{\"answer\": \"first\"}\n``` then\n```json\n"), made, F.lit("\n```"))
    reply = F.when(F.col("n") == 0, fenced).when(F.col("n") == 1, F.concat(F.lit("Here: "), made)).otherwise(F.col("text"))
    return t.select("turn_id", fx.final_answer(reply).alias("f")).select("turn_id", F.regexp_replace("f.answer", "\\s+", " ").alias("answer"), F.size("f.citations").alias("n_citations"), "f.parsed")


def f17_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read tolerantly and held between 0 and 1: pages of mentions as text, some of them no numbers."""
    m = table(spark, d, "mentions").select("mention_id", "page").distinct()
    said = F.when(F.col("page") % 3 == 0, "none").when(F.col("page") % 3 == 1, F.concat(F.lit("0."), F.col("page").cast("string"))).otherwise(F.col("page").cast("string"))
    return m.select("mention_id", fx.clamp_float(said, 0.7).alias("confidence"))


def case_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every case's pages in one row. A document has as many as its print."""
    pages = all_pages(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return pages.join(known_cases(spark, d).select(F.col("id").alias("case_id"), "domain"), "case_id")


def g2_segments(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each case, found by their headings. The tables' own names sit as justices."""
    names = table(spark, d, "segments").select(F.upper(F.regexp_extract("label", r"(?i)^(?:JUSTICE )?([A-Z]+)\\b.*(?:concurring|dissenting)", 1)).alias("n")).filter("n <> ''").distinct().orderBy("n").limit(200)
    return chunking.segments(case_documents(spark, d), tuple(r[0] for r in names.collect()) or chunking.JUSTICES)


def g8_calls(spark: SparkSession, d: str) -> DataFrame:
    """The majority part on whose pages each mention stands."""
    nodes = table(spark, d, "mentions").select("case_id", F.col("mention_id").alias("node_id"), F.lit("majority").alias("part"), F.array("page").alias("pages")).distinct()
    parts = table(spark, d, "segments").select("case_id", F.col("part_name").alias("part"), "seg_id", "start_page", "start_char", "end_page").distinct()
    return chunking.planned_calls(nodes.filter("case_id IS NOT NULL"), parts)


def g9_within(spark: SparkSession, d: str) -> DataFrame:
    """Units all of whose pages lie between the first and the fourth."""
    items = table(spark, d, "units").select("unit_id", F.transform("pages", lambda p: p["page"]).alias("pages")).distinct()
    return chunking.within_window(items, F.lit(1), F.lit(4)).select("unit_id")


def b11_tier(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the kind `other` as rules: the doctrines that their cases invoke."""
    m = table(spark, d, "mentions").filter("kind = 'other' AND case_id IS NOT NULL AND trim(coalesce(display, '')) <> ''").select("mention_id", "case_id", "display", "page", "quote").distinct()
    no = F.lit(None).cast("string")
    evidence = F.array(F.struct("page", "quote"))
    nodes = m.select(F.col("mention_id").alias("unit_id"), "case_id", F.col("mention_id").alias("id"), F.lit("rule").alias("type"), F.col("display").alias("label"), no.alias("author"), no.alias("part"), F.when(F.col("page") % 2 == 0, "unverified").otherwise("llm").alias("provenance"), (F.col("page") / 100).alias("confidence"), no.alias("cite_string"), no.alias("kind"), no.alias("doctrine"), evidence.alias("evidence"))
    edges = spark.createDataFrame([], "unit_id string, case_id string, source string, target string, relation string, stance string, provenance string, confidence double, evidence array<struct<page: int, quote: string>>")
    out = g.mapped_tier(nodes, edges, known_cases(spark, d))
    return out.select("type", "source", "target", "provenance", F.round("confidence", 6).alias("confidence"))


def b12_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Doctrines with a passage of the case's first page as their quote, and with one that isn't there."""
    first = all_pages(spark, d).filter("page = 1 AND length(text) > 130").select("case_id", F.substring("text", 40, 90).alias("quote"))
    doctrine = lambda name, quote: F.struct(F.lit(name).alias("name"), quote.alias("quote"), F.lit("1").alias("page"))
    replies = first.select("case_id", F.to_json(F.struct(F.array(doctrine("Harbor Pass", F.col("quote")), doctrine("Made Up", F.lit("words that no page of any case has"))).alias("doctrines"))).alias("text"))
    edges, lost = extraction.accepted_case_data(replies, all_pages(spark, d), known_cases(spark, d))
    kept = edges.groupBy(F.col("target").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(lost.select(F.col("reason").alias("what"), "n"))


def e1_valid(spark: SparkSession, d: str) -> DataFrame:
    """Why mentions would be rejected as items of a model."""
    m = table(spark, d, "mentions").select("mention_id", "kind", "display", "quote", "page").distinct()
    kind = F.when(F.col("page") % 4 == 0, "authority_ref").when(F.col("page") % 4 == 1, "rule").when(F.col("page") % 4 == 2, "fact").otherwise(F.col("kind"))
    raw = m.select("mention_id", kind.alias("type"), F.col("display").alias("label"), F.lit(None).cast("string").alias("summary"), F.lit("majority").alias("part"), F.lit(" ").alias("author"), "kind", F.when(F.col("kind") != "other", F.col("display")).alias("cite_string"), F.when(F.col("quote").isNotNull(), 1).otherwise(0).alias("n_quotes"))
    return evaluation.valid_nodes(raw).select("mention_id", "kind", "reason")


def e2_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Between the cases of which domains there are matches of which basis."""
    one = F.lit("all").alias("unit_id")
    nodes = known_cases(spark, d).select(one, "id", F.col("domain").alias("type"))
    edges = table(spark, d, "matches").select(one, "source", "target", F.col("basis").alias("relation"))
    return evaluation.derived_signatures(nodes, edges)


def m3_edges(spark: SparkSession, d: str) -> DataFrame:
    """Matches on even pages paired one to one with those on pages that three divides, of the same ends and basis."""
    m = table(spark, d, "matches").filter("source IS NOT NULL AND target IS NOT NULL").select("match_id", "source", "target", "basis", "page").distinct()
    rows = m.select(F.lit("all").alias("unit_id"), F.col("match_id").alias("edge_no"), "source", "target", F.coalesce("basis", F.lit("")).alias("relation"), "page")
    ids = m.select(F.explode(F.array("source", "target")).alias("id")).distinct().select(F.lit("all").alias("unit_id"), F.col("id").alias("pred_id"), F.col("id").alias("gold_id"))
    return evaluation.matched_edges(rows.filter("page % 2 = 0").drop("page"), rows.filter("page % 3 = 0").drop("page"), ids).select("pred_no", "gold_no")


def t8_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as starts and ends, by their number: each end with the last start that has no end yet."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 == 0, "end").otherwise("start").alias("kind"))
    return ledger.paired_spans(e, ["user_id"], "ts", "kind")


def v6_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Whether titles before a citation are other names than those that it was resolved to: every second one's is."""
    r = known_cases(spark, d).select("id", "title")
    resolved = F.when(F.length("title") % 2 == 0, F.upper("title")).otherwise("Roe v. Doe")
    return r.select("id", answers.name_mismatch(F.concat("title", F.lit(", 12 U.S. 34")), resolved).alias("mismatch"))


def v9_altered(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose first letter stands in brackets in the other case, on any page of their case."""
    pages = all_pages(spark, d)
    letter = F.substring("text", 40, 1)
    other = F.when(F.lower(letter) == letter, F.upper(letter)).otherwise(F.lower(letter))
    q = pages.filter((F.length("text") > 130) & letter.rlike("^[A-Za-z]$")).select(F.concat_ws("#", "case_id", F.col("page").cast("string")).alias("quote_id"), "case_id", F.concat(F.lit("["), other, F.lit("]"), F.substring("text", 41, 60)).alias("quote"))
    return quotes.altered_quotes(q, pages, ["quote_id"])


def e5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Facts extracted from replies that quote a passage of each page, and one that isn't there."""
    pages = all_pages(spark, d)
    quoted = pages.filter("length(text) > 130").select("case_id", F.struct(F.lit("fact").alias("type"), F.concat(F.lit("Passage "), F.col("page").cast("string")).alias("label"), F.array(F.struct(F.col("page").cast("string").alias("page"), F.when(F.col("page") % 3 == 0, "words that no page of any case has").otherwise(F.substring("text", 40, 90)).alias("quote"))).alias("evidence")).alias("n"))
    replies = quoted.groupBy(F.col("case_id").alias("unit_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list("n")).alias("nodes"))).alias("text")).select("unit_id", F.lit("nodes").alias("stage"), "text", F.lit("stop").alias("finish_reason"))
    units = pages.select(F.col("case_id").alias("unit_id"), "case_id", F.lit(None).cast("int").alias("repeated_page")).distinct()
    return extraction.extracted_nodes(replies, units, pages).groupBy("case_id", "provenance").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        v6_mismatch, v9_altered, e5_nodes,
        s1_records, s2_manifest, s5_graph, s8_query, s10_runs, s11_cached, s15_usage, f7_patterns, f15_final, f17_numbers, g2_segments, g8_calls, g9_within, b11_tier, b12_accepted, e1_valid, e2_signatures,
        m3_edges, t8_pairs,
    )
}

_TURNS = "t AS (SELECT DISTINCT turn_id, latency_s, input_tokens, output_tokens, revisions FROM turns)"
ORACLES = {
    "s1_records": """SELECT CASE length(title) % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'missing title' WHEN 2 THEN 'missing pages' ELSE 'record' END AS reason, count(*) AS n FROM (SELECT DISTINCT id, title FROM records) GROUP BY 1""",
    "s2_manifest": "SELECT 'llm_settings.parquet' AS path, 'checksum mismatch' AS problem UNION ALL SELECT 'absent.parquet', 'missing'",
    "s5_graph": f"WITH {_SMALL} SELECT 'node label' AS what, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'edge provenance', provenance, count(*) FROM edges GROUP BY provenance",
    "s8_query": f"WITH {_SMALL} SELECT e.type, n.label, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.target GROUP BY e.type, n.label",
    "s10_runs": "SELECT 'qa_' || system AS run, count(DISTINCT turn_id) AS n FROM turns GROUP BY system",
    "s11_cached": "SELECT doc_id, EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text IS NOT DISTINCT FROM d.text) AS cached FROM documents d",
    "s15_usage": f"""WITH {_TURNS} SELECT turn_id, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, 'id' AS matched_by FROM t WHERE revisions > 0
UNION ALL SELECT a.turn_id, arg_max(b.input_tokens, b.turn_id)::BIGINT, arg_max(b.output_tokens, b.turn_id)::BIGINT, 'latency' FROM t a JOIN t b ON abs(a.latency_s - b.latency_s) < 0.02 WHERE a.revisions <= 0 GROUP BY a.turn_id""",
    "f7_patterns": "SELECT DISTINCT raw, true AS spaced, false AS inside FROM (SELECT unnest(citations) AS raw FROM records) WHERE raw IS NOT NULL",
    "f15_final": "SELECT turn_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS answer, (CASE WHEN length(text) % 3 < 2 THEN 1 ELSE 0 END)::INT AS n_citations, length(text) % 3 < 2 AS parsed FROM (SELECT DISTINCT turn_id, regexp_replace(text, '[`{}]', '', 'g') AS text FROM turns)",
    "f17_numbers": "SELECT mention_id, CASE WHEN page IS NULL OR page % 3 = 0 THEN 0.7::DOUBLE WHEN page % 3 = 1 THEN ('0.' || page)::DOUBLE ELSE least(page, 1)::DOUBLE END AS confidence FROM (SELECT DISTINCT mention_id, page FROM mentions)",
    "g8_calls": """WITH m AS (SELECT DISTINCT case_id, mention_id, page FROM mentions WHERE case_id IS NOT NULL), s AS (SELECT DISTINCT case_id, seg_id, start_page, start_char, end_page FROM segments WHERE part_name = 'majority')
SELECT m.case_id, m.mention_id AS node_id, arg_min(s.seg_id, s.start_page * 1000000 + s.start_char) AS seg_id FROM m LEFT JOIN s ON s.case_id = m.case_id AND m.page BETWEEN s.start_page AND s.end_page GROUP BY m.case_id, m.mention_id""",
    "g9_within": "SELECT unit_id FROM (SELECT DISTINCT unit_id, list_transform(pages, lambda p: p.page) AS p FROM units) WHERE len(list_filter(p, lambda x: x < 1 OR x > 4)) = 0",
    "b11_tier": f"""WITH m AS (SELECT DISTINCT mention_id, case_id, display, page FROM mentions WHERE kind = 'other' AND case_id IS NOT NULL AND trim(coalesce(display, '')) <> '' AND page % 2 <> 0)
SELECT 'INVOKES_DOCTRINE' AS type, case_id AS source, 'doctrine:' || {sql.slug(sql.squash("display"))} AS target, 'llm' AS provenance, round(max(page / 100), 6) AS confidence FROM m GROUP BY 2, 3""",
    "b12_accepted": f"WITH {sql.PAGES} SELECT 'doctrine:harbor_pass' AS what, count(*) AS n FROM pages WHERE page = 1 AND length(text) > 130 UNION ALL SELECT 'doctrine_unverified_quote', count(*) FROM pages WHERE page = 1 AND length(text) > 130",
    "v6_mismatch": f"""WITH {sql.CASES}, w AS (SELECT id, title, CASE WHEN length(title) % 2 = 0 THEN lower(title) ELSE 'roe v. doe' END AS other, list_filter(regexp_extract_all(lower(title), '[a-z][a-z''-]{{3,}}'), lambda x: x NOT IN ('matter', 'united', 'states', 'the', 'and', 'rel.')) AS ws FROM cases)
SELECT id, len(ws) > 0 AND len(list_filter(ws, lambda x: contains(other, x))) = 0 AS mismatch FROM w""",
    "v9_altered": f"WITH {sql.PAGES} SELECT case_id || '#' || page AS quote_id FROM pages WHERE length(text) > 130 AND regexp_matches(substring(text, 40, 1), '[A-Za-z]') AND length({sql.match_key('substring(text, 41, 60)')}) >= 12",
    "e1_valid": """WITH m AS (SELECT DISTINCT mention_id, kind, display, quote, page FROM mentions), r AS (SELECT *, CASE page % 4 WHEN 0 THEN 'authority_ref' WHEN 1 THEN 'rule' WHEN 2 THEN 'fact' ELSE kind END AS type FROM m)
SELECT mention_id, CASE WHEN type = 'authority_ref' AND (kind IS NULL OR kind NOT IN ('case', 'statute', 'regulation', 'constitution', 'other')) THEN 'other' ELSE kind END AS kind,
CASE WHEN type IS NULL OR type NOT IN ('opinion', 'issue', 'fact', 'rule', 'holding', 'reasoning', 'outcome', 'authority_ref') THEN 'unknown node type: ' || coalesce(type, 'None') WHEN trim(coalesce(display, '')) = '' THEN 'missing label' WHEN quote IS NULL THEN 'missing evidence'
WHEN type = 'authority_ref' AND trim(coalesce(CASE WHEN kind <> 'other' THEN display END, '')) = '' THEN 'authority_ref without cite_string' END AS reason FROM r""",
    "e2_signatures": f"WITH {sql.CASES} SELECT DISTINCT a.domain AS source_type, m.basis AS relation, b.domain AS target_type FROM matches m JOIN cases a ON a.id = m.source JOIN cases b ON b.id = m.target",
    "m3_edges": """WITH m AS (SELECT DISTINCT match_id, source, target, coalesce(basis, '') AS basis, page FROM matches WHERE source IS NOT NULL AND target IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY source, target, basis ORDER BY match_id) AS k FROM m WHERE page % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY source, target, basis ORDER BY match_id) AS k FROM m WHERE page % 3 = 0)
SELECT a.match_id AS pred_no, b.match_id AS gold_no FROM a JOIN b USING (source, target, basis, k)""",
}
