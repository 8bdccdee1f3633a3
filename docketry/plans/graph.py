"""Queries over the citation graph (B), search (R) and analytics (A)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import slug
from docketry.operators import analytics, search
from docketry.operators import graph as g
from docketry.operators.chunking import active_parts, annotated_pages, packed_units, page_contexts
from docketry.operators.mentions import extract_mentions
from docketry.plans import sql
from docketry.sources.tables import checkpointed, table

QUERY = "harbor pass statutory deadline notice of removal"
ROUNDS = 3


def known_cases(spark: SparkSession, d: str) -> DataFrame:
    return g.cases(table(spark, d, "records"), table(spark, d, "lead_records"))


def all_pages(spark: SparkSession, d: str) -> DataFrame:
    return g.case_pages(table(spark, d, "units"))


def cited(spark: SparkSession, d: str) -> DataFrame:
    """Distinct source, target, scope of detected citations."""
    known = known_cases(spark, d)
    rows = g.resolved_citations(g.detected_citations(table(spark, d, "records"), known), known)
    return rows.select(F.col("case_id").alias("source"), "target", "scope").distinct()


def small_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases, authorities, statutes and doctrines with the edges between them, without pages and quotations: what rankings need.

    Mentions of the kind `other` stand for doctrines.
    """
    known, cites = known_cases(spark, d), cited(spark, d)
    no = lambda t: F.lit(None).cast(t)
    evidence = F.array().cast("array<struct<page: int, quote: string>>").alias("evidence")
    law = table(spark, d, "mentions").select("mention_id", "case_id", "canon_id", "kind", "display").distinct().filter(F.col("canon_id").isNotNull() & F.col("case_id").isNotNull())
    laws = law.filter(F.col("kind").isin("statute", "regulation"))
    one = cites.select(F.lit("CITES").alias("type"), "source", "target", "scope", no("bigint").alias("count"), F.lit("deterministic").alias("provenance"), F.lit(1.0).alias("confidence"))
    two = laws.groupBy(F.col("case_id").alias("source"), F.col("canon_id").alias("target")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("MENTIONS_STATUTE").alias("type"), "source", "target", no("string").alias("scope"), "count", F.lit("deterministic").alias("provenance"), F.lit(1.0).alias("confidence"))
    m = g.upsert_edges(g.match_edges(table(spark, d, "matches"))).select("type", "source", "target", "scope", F.col("count"), "provenance", "confidence")
    other = law.filter((F.col("kind") == "other") & (F.trim(F.coalesce("display", F.lit(""))) != "")).select(F.lit("INVOKES_DOCTRINE").alias("type"), F.col("case_id").alias("source"), F.concat(F.lit("doctrine:"), slug(F.col("display"))).alias("target"), no("string").alias("scope"), no("bigint").alias("count"), F.lit("llm").alias("provenance"), F.lit(0.8).alias("confidence")).distinct()
    m = m.join(one.select("type", "source", "target"), ["type", "source", "target"], "left_anti")
    edges = one.unionByName(two).unionByName(m).unionByName(other).withColumn("bases", F.array().cast("array<string>")).withColumn("evidence", evidence)
    nodes = known.select("id", F.lit("Case").alias("label"), "title", F.col("citation").alias("display"), "domain")
    nodes = nodes.unionByName(cites.filter("scope = 'external'").select(F.col("target").alias("id"), F.lit("Authority").alias("label"), no("string").alias("title"), no("string").alias("display"), no("string").alias("domain")).distinct())
    statutes = laws.groupBy("canon_id").agg(F.min("kind").alias("kind"), F.min("display").alias("display")).select(F.col("canon_id").alias("id"), F.when(F.col("kind") == "regulation", "Regulation").otherwise("Statute").alias("label"), no("string").alias("title"), "display", no("string").alias("domain"))
    doctrines = other.select(F.col("target").alias("id"), F.lit("Doctrine").alias("label"), no("string").alias("title"), no("string").alias("display"), no("string").alias("domain")).distinct()
    nodes = checkpointed(nodes.unionByName(statutes).unionByName(doctrines))
    return nodes, g.without_dangling(nodes, edges)


def lead(spark: SparkSession, d: str) -> str:
    """The case that the single-case queries ask about: the first of the lead records."""
    return table(spark, d, "lead_records").agg(F.min("id")).first()[0]


def chain_start(spark: SparkSession, d: str) -> str:
    """The first case that another record cites."""
    return cited(spark, d).filter("scope <> 'external'").agg(F.min("source")).first()[0]


def b3_case_nodes(spark: SparkSession, d: str) -> DataFrame:
    return known_cases(spark, d).select("id", "domain", "title", "citation", "court", "canon_id")


def b3_page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return all_pages(spark, d).select("case_id", "page", F.length("text").alias("n_chars"))


def b4_citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return cited(spark, d)


def b5_statute_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = g.upsert_edges(g.statute_edges(table(spark, d, "mentions"))[0])
    return edges.select("source", "target", "count", "provenance", F.size("evidence").alias("n_evidence"), F.element_at("evidence", 1)["page"].alias("first_page"))


def b6_match_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = g.upsert_edges(g.match_edges(table(spark, d, "matches")))
    return edges.select("source", "target", F.array_join(F.array_sort("bases"), ",").alias("bases"), "provenance", "confidence", F.size("evidence").alias("n_evidence"))


def b6_text_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches found in the pages' texts."""
    return g.cross_domain_matches(known_cases(spark, d), all_pages(spark, d), "immigration", "litigation")


def b8_graph(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the deterministic tier."""
    nodes, edges = g.build_graph(*(table(spark, d, t) for t in ("records", "lead_records", "units", "mentions", "matches")))
    out = g.with_labels(nodes, edges)
    return out.select("type", "source", "target", "source_label", "target_label", "scope", F.array_join("bases", ",").alias("bases"), "count", "provenance", "confidence", F.to_json("evidence").alias("evidence"))


def b9_check(spark: SparkSession, d: str) -> DataFrame:
    """Reporter matches that no detected citation bears out, and the reverse."""
    found = cited(spark, d).filter("scope = 'cross_domain'").select(F.lit("CITES").alias("type"), "source", "target", F.array(F.lit("reporter")).alias("bases"))
    expected = table(spark, d, "matches").filter("basis = 'reporter' AND source IS NOT NULL AND target IS NOT NULL").select("source", "target", "basis")
    return g.check_edges(found, expected)


def b10_merged(spark: SparkSession, d: str) -> DataFrame:
    """Matches as the first tier and detected citations as the second, over the known cases."""
    nodes = known_cases(spark, d).select("id", F.lit("Case").alias("label"))
    m = table(spark, d, "matches").filter("source IS NOT NULL AND target IS NOT NULL").select(F.lit("CITES").alias("type"), "source", "target", F.lit("match").alias("origin")).distinct()
    c = cited(spark, d).select(F.lit("CITES").alias("type"), "source", "target", F.lit("citation").alias("origin"))
    return g.merge_tiers((nodes, m), (nodes, c))[1]


def a1_citing(spark: SparkSession, d: str) -> DataFrame:
    return analytics.find_citing(*small_graph(spark, d), lead(spark, d)).select("type", "case_id", "title", "domain", "scope", "confidence")


def a2_cited(spark: SparkSession, d: str) -> DataFrame:
    return analytics.find_cited(*small_graph(spark, d), chain_start(spark, d)).select("type", "cited_id", "label", "scope")


def a3_chains(spark: SparkSession, d: str) -> DataFrame:
    """How far the cases within three citations of one are."""
    return analytics.precedent_chain(*small_graph(spark, d), chain_start(spark, d), 3).select("target", "domain", "depth")


def a3_paths(spark: SparkSession, d: str) -> DataFrame:
    """One shortest chain to each of them in litigation."""
    return analytics.precedent_chain(*small_graph(spark, d), chain_start(spark, d), 3, "litigation")


def a4_pagerank(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = small_graph(spark, d)
    keep = nodes.filter(F.col("label").isin("Case", "Authority"))
    return analytics.pagerank(keep, edges.filter(F.col("type") == "CITES"), rounds=ROUNDS, tolerance=0).select("id", F.round("rank", 10).alias("rank"))


def a5_most_cited(spark: SparkSession, d: str) -> DataFrame:
    return analytics.most_cited(*small_graph(spark, d), k=20, method="indegree", rounds=2).select("rank", "id", "kind", "domain", "cited_by", "citing_domains")


def a6_statutes(spark: SparkSession, d: str) -> DataFrame:
    return analytics.statute_frequency(*small_graph(spark, d), k=25)


def a7_doctrines(spark: SparkSession, d: str) -> DataFrame:
    return analytics.doctrine_influence(*small_graph(spark, d), k=25, rounds=2)


def a8_bridges(spark: SparkSession, d: str) -> DataFrame:
    return analytics.cross_corpus_bridges(*small_graph(spark, d))


def a9_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_stats(*small_graph(spark, d))


def r2_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), QUERY, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


def r3_search_pages(spark: SparkSession, d: str) -> DataFrame:
    return search.search_pages(all_pages(spark, d), known_cases(spark, d), QUERY, limit=10).select("rank", "case_id", "page", "score", "title")


def r4_search_cases(spark: SparkSession, d: str) -> DataFrame:
    return search.search_cases(known_cases(spark, d), all_pages(spark, d), QUERY, limit=25)


def r5_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The cases that the records' citations, as typed, and their titles mean."""
    r = table(spark, d, "records")
    return search.resolve(r.select(F.col("citation").alias("ref")).unionByName(r.select(F.col("title").alias("ref"))), known_cases(spark, d))


def r6_cases(spark: SparkSession, d: str) -> DataFrame:
    return search.case_summaries(known_cases(spark, d), all_pages(spark, d), small_graph(spark, d)[1], g.CITATION_EDGES).select("id", "n_pages", "n_cites", "n_cited_by", "statutes")


def r7_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each case that has units."""
    return all_pages(spark, d).filter(F.col("page") == 1).select("case_id", "page", "text")


def r8_dense(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest vectors of each whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return search.dense_top_k(e, e.filter(F.col("vec_id") % 100 == 0)).select("query_id", "rank", "vec_id", "score")


def g1_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Statutes and regulations named on each page, and how often."""
    rows = extract_mentions(all_pages(spark, d), ("usc", "cfr", "ina_symbol", "ina_section"))
    return rows.groupBy("case_id", "page", "pattern", "canon_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_at"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("seg_id", "case_id", F.col("part_name").alias("part"), "label", "start_page", "start_char", "end_page", "end_char").distinct()


def g3_active_parts(spark: SparkSession, d: str) -> DataFrame:
    return active_parts(all_pages(spark, d), _parts(spark, d))


def g3_annotated(spark: SparkSession, d: str) -> DataFrame:
    return annotated_pages(all_pages(spark, d), _parts(spark, d))


def g4_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of up to 4,000 characters."""
    return packed_units(all_pages(spark, d), 4000)


def g7_contexts(spark: SparkSession, d: str) -> DataFrame:
    return page_contexts(all_pages(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        b3_case_nodes, b3_page_nodes, b4_citation_edges, b5_statute_edges, b6_match_edges, b6_text_matches, b8_graph, b9_check, b10_merged, a1_citing, a2_cited, a3_chains, a3_paths, a4_pagerank,
        a5_most_cited, a6_statutes, a7_doctrines, a8_bridges, a9_stats, r2_bm25, r3_search_pages, r4_search_cases, r5_resolved, r6_cases, r7_page, r8_dense, g1_mentions, g3_active_parts, g3_annotated, g4_units, g7_contexts,
    )
}

_DOCTRINE = "'doctrine:' || " + sql.slug("display")
_SMALL = f"""{sql.CASES}, {sql.CITED}, {sql.MATCHED},
law AS (SELECT DISTINCT mention_id, case_id, canon_id, kind, display FROM mentions WHERE canon_id IS NOT NULL AND case_id IS NOT NULL),
medges AS (SELECT DISTINCT source, target FROM matched m WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.source = m.source AND c.target = m.target)),
conf AS (SELECT source, target, coalesce(max(CASE WHEN quote IS NOT NULL THEN CASE WHEN basis = 'name' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END END), 0.5::DOUBLE) AS confidence, max(CASE WHEN quote IS NOT NULL THEN 1 ELSE 0 END) AS sure FROM matched GROUP BY source, target),
nodes AS (SELECT id, 'Case' AS label, title, citation AS display, domain FROM cases UNION ALL SELECT DISTINCT target, 'Authority', NULL, NULL, NULL FROM cited WHERE scope = 'external'
UNION ALL SELECT canon_id, CASE WHEN min(kind) = 'regulation' THEN 'Regulation' ELSE 'Statute' END, NULL, min(display), NULL FROM law WHERE kind IN ('statute', 'regulation') GROUP BY canon_id
UNION ALL SELECT DISTINCT {_DOCTRINE}, 'Doctrine', NULL, NULL, NULL FROM law WHERE kind = 'other' AND trim(coalesce(display, '')) <> ''),
edges0 AS (SELECT 'CITES' AS type, source, target, scope, NULL::BIGINT AS n, 'deterministic' AS provenance, 1.0::DOUBLE AS confidence FROM cited
UNION ALL SELECT 'MENTIONS_STATUTE', case_id, canon_id, NULL, count(*), 'deterministic', 1.0::DOUBLE FROM law WHERE kind IN ('statute', 'regulation') GROUP BY case_id, canon_id
UNION ALL SELECT 'CITES', m.source, m.target, 'cross_domain', NULL, CASE WHEN c.sure = 1 THEN 'deterministic' ELSE 'unverified' END, c.confidence FROM medges m JOIN conf c USING (source, target)
UNION ALL SELECT DISTINCT 'INVOKES_DOCTRINE', case_id, {_DOCTRINE}, NULL, NULL::BIGINT, 'llm', 0.8::DOUBLE FROM law WHERE kind = 'other' AND trim(coalesce(display, '')) <> ''),
edges AS (SELECT e.* FROM edges0 e WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"""
# Each of these is used several times, and holds regular expressions: DuckDB is to compute it once.
_SMALL = re.sub(r"(?<=\w) AS \((?=SELECT|\s*SELECT)", " AS MATERIALIZED (", _SMALL)
_PAIRS = "keep AS (SELECT id FROM nodes WHERE label IN ('Case', 'Authority')), pairs AS (SELECT DISTINCT source, target FROM edges WHERE type = 'CITES')"
_START = "(SELECT min(source) FROM cited WHERE scope <> 'external')"
_LINKS = "links AS (SELECT DISTINCT source, target FROM edges e JOIN nodes n ON n.id = e.target WHERE type = 'CITES' AND n.label = 'Case')"


def _bm25(docs: str, key: str) -> str:
    """CTEs that end in `scored` (key, score) for a relation of key and text."""
    return f"""docs AS ({docs}), toks AS (SELECT {key}, {sql.tokens("coalesce(text, '')")} AS t FROM docs),
lens AS (SELECT {key}, len(t) AS n FROM toks), tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(t) AS term FROM toks) GROUP BY {key}, term),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest({sql.tokens("'" + QUERY + "'")}) AS term) GROUP BY term), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (SELECT {key}, sum(times * ln(1 + ((SELECT count(*) FROM docs) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(n) FROM lens)))) AS score
FROM tf JOIN q USING (term) JOIN df USING (term) JOIN lens USING ({key}) GROUP BY {key})"""


ORACLES = {
    "b3_case_nodes": f"WITH {sql.CASES} SELECT id, domain, title, citation, court, canon_id FROM cases",
    "b3_page_nodes": f"WITH {sql.PAGES} SELECT case_id, page, length(text) AS n_chars FROM pages",
    "b4_citation_edges": f"WITH {sql.CASES}, {sql.CITED} SELECT source, target, scope FROM cited",
    "b5_statute_edges": """WITH m AS (SELECT DISTINCT mention_id, case_id, canon_id, page, quote FROM mentions WHERE kind IN ('statute', 'regulation') AND canon_id IS NOT NULL AND case_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, canon_id ORDER BY page, mention_id) AS k, count(*) OVER (PARTITION BY case_id, canon_id) AS n FROM m)
SELECT case_id AS source, canon_id AS target, max(n) AS count, 'deterministic' AS provenance, len(list_distinct(list(page || '|' || coalesce(quote, '')))) AS n_evidence, min(CASE WHEN k = 1 THEN page END) AS first_page FROM r WHERE k <= 3 GROUP BY case_id, canon_id""",
    "b6_match_edges": f"""WITH {sql.MATCHED} SELECT source, target, array_to_string(list_sort(list_distinct(list(basis) FILTER (basis IS NOT NULL))), ',') AS bases, CASE WHEN count(quote) > 0 THEN 'deterministic' ELSE 'unverified' END AS provenance,
coalesce(max(CASE WHEN quote IS NOT NULL THEN CASE WHEN basis = 'name' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END END), 0.5::DOUBLE) AS confidence, least(3, count(DISTINCT CASE WHEN quote IS NOT NULL THEN coalesce(page, -1) || '|' || quote END)) AS n_evidence FROM matched GROUP BY source, target""",
    "b9_check": f"""WITH {sql.CASES}, {sql.CITED}, a AS (SELECT source, target FROM cited WHERE scope = 'cross_domain'), e AS (SELECT DISTINCT source, target FROM matches WHERE basis = 'reporter' AND source IS NOT NULL AND target IS NOT NULL AND source IN (SELECT source FROM a))
SELECT 'missing' AS status, source, target, 'reporter' AS basis FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT 'extra', source, target, 'reporter' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""",
    "b10_merged": f"""WITH {sql.CASES}, {sql.CITED}, u AS (SELECT DISTINCT source, target, 'match' AS origin, 0 AS tier FROM matches WHERE source IS NOT NULL AND target IS NOT NULL UNION ALL SELECT source, target, 'citation', 1 FROM cited)
SELECT 'CITES' AS type, source, target, arg_min(origin, tier) AS origin FROM u WHERE source IN (SELECT id FROM cases) AND target IN (SELECT id FROM cases) GROUP BY source, target""",
    "a1_citing": f"WITH {_SMALL} SELECT e.type, e.source AS case_id, n.title, n.domain, e.scope, e.confidence FROM edges e LEFT JOIN nodes n ON n.id = e.source WHERE e.type = 'CITES' AND e.target = (SELECT min(id) FROM lead_records)",
    "a2_cited": f"WITH {_SMALL} SELECT e.type, e.target AS cited_id, n.label, e.scope FROM edges e LEFT JOIN nodes n ON n.id = e.target WHERE e.type = 'CITES' AND e.source = {_START}",
    "a3_chains": f"""WITH {_SMALL}, {_LINKS}, l0 AS (SELECT {_START} AS id), l1 AS (SELECT DISTINCT target AS id FROM links WHERE source IN (SELECT id FROM l0) AND target NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT target AS id FROM links WHERE source IN (SELECT id FROM l1) AND target NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1)),
l3 AS (SELECT DISTINCT target AS id FROM links WHERE source IN (SELECT id FROM l2) AND target NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2))
SELECT x.id AS target, c.domain, x.depth FROM (SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) x JOIN cases c USING (id)""",
    "a4_pagerank": f"WITH {_SMALL}, {_PAIRS}, {sql.pagerank('keep', 'pairs', ROUNDS)} SELECT id, round(rank, 10) AS rank FROM ranks{ROUNDS}",
    "a5_most_cited": f"""WITH {_SMALL}, {_PAIRS}, {sql.pagerank("keep", "pairs", 2)}, deg2 AS (SELECT target AS id, count(*) AS cited_by FROM pairs GROUP BY target),
top AS (SELECT id, cited_by, row_number() OVER (ORDER BY cited_by DESC, round(r.rank, 12) DESC, id) AS rank FROM deg2 JOIN ranks2 r USING (id) QUALIFY row_number() OVER (ORDER BY cited_by DESC, round(r.rank, 12) DESC, id) <= 20),
doms AS (SELECT p.target AS id, n.domain, count(*) AS k FROM pairs p JOIN nodes n ON n.id = p.source GROUP BY p.target, n.domain), lists AS (SELECT id, string_agg(domain || ':' || k, ' ' ORDER BY domain) AS citing_domains FROM doms GROUP BY id)
SELECT t.rank::INT AS rank, t.id, n.label AS kind, n.domain, t.cited_by, l.citing_domains FROM top t JOIN nodes n USING (id) JOIN lists l USING (id)""",
    "a6_statutes": f"""WITH {_SMALL}, f AS (SELECT target AS id, count(*) AS cases, sum(n)::BIGINT AS mentions FROM edges WHERE type = 'MENTIONS_STATUTE' GROUP BY target), t AS (SELECT *, row_number() OVER (ORDER BY cases DESC, mentions DESC, id)::INT AS rank FROM f)
SELECT t.rank, t.id, n.display, n.label AS kind, t.cases, t.mentions FROM t JOIN nodes n USING (id) WHERE t.rank <= 25""",
    "a7_doctrines": f"""WITH {_SMALL}, keepc AS (SELECT id FROM nodes WHERE label = 'Case'), linksc AS (SELECT e.source, e.target FROM edges e JOIN keepc a ON a.id = e.source JOIN keepc b ON b.id = e.target WHERE type = 'CITES'), {sql.pagerank("keepc", "linksc", 2)},
u AS (SELECT e.target AS id, count(DISTINCT e.source) AS cases, sum(coalesce(r.rank, 0)) AS influence, avg(e.confidence) AS mean_confidence FROM edges e LEFT JOIN ranks2 r ON r.id = e.source WHERE type = 'INVOKES_DOCTRINE' GROUP BY e.target), t AS (SELECT *, row_number() OVER (ORDER BY cases DESC, influence DESC, id)::INT AS rank FROM u)
SELECT rank, id, cases, round(influence, 6) AS influence, round(mean_confidence, 3) AS mean_confidence FROM t WHERE rank <= 25""",
    "a8_bridges": f"""WITH {_SMALL}, p AS (SELECT DISTINCT source, target FROM edges WHERE type = 'CITES' AND scope = 'cross_domain'), b AS (SELECT target AS id, count(*) AS citing FROM p GROUP BY target), t AS (SELECT *, row_number() OVER (ORDER BY citing DESC, id)::INT AS rank FROM b)
SELECT t.rank, t.id, n.title, t.citing, (SELECT count(*) FROM p) AS unique_pairs, (SELECT count(*) FROM b) AS bridged FROM t LEFT JOIN nodes n USING (id) WHERE t.rank <= 20""",
    "a9_stats": f"WITH {_SMALL} SELECT 'node label' AS what, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'edge provenance', provenance, count(*) FROM edges GROUP BY provenance",
    "r2_bm25": f"WITH {_bm25('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, round(score, 6) AS score FROM scored",
    "r3_search_pages": f"""WITH {sql.CASES}, {sql.PAGES}, {_bm25("SELECT case_id || '#' || page AS k, case_id, page, text FROM pages", "k")}, t AS (SELECT d.case_id, d.page, s.score, row_number() OVER (ORDER BY s.score DESC, d.case_id, d.page)::INT AS rank FROM scored s JOIN docs d USING (k))
SELECT t.rank, t.case_id, t.page, round(t.score, 3) AS score, c.title FROM t LEFT JOIN cases c ON c.id = t.case_id WHERE t.rank <= 10""",
    "r5_resolved": f"""WITH {sql.CASES}, q0 AS (SELECT citation AS ref FROM records UNION SELECT title FROM records), q1 AS (SELECT ref, {sql.squash("ref")} AS s FROM q0 WHERE ref IS NOT NULL), q AS (SELECT ref, s, {sql.canon("s", "id")} AS cid, {sql.canon("s", "kind")} AS kind,
regexp_replace(trim(regexp_replace(lower(s), '^(in re|matter of)\\s+', '')), '^[ ,.]+|[ ,.]+$', '', 'g') AS name FROM q1 WHERE s <> ''), own AS (SELECT canon_id, max(id) AS id FROM cases WHERE canon_id NOT LIKE 'nocite:%' GROUP BY canon_id),
n AS (SELECT id, lower(title) AS title, trim(regexp_replace(lower(title), '^(in re|matter of)\\s+', '')) AS bare FROM cases), named AS (SELECT q.ref, min(n.id) AS id FROM q JOIN n ON q.name = n.bare OR q.name = n.title OR length(q.name) > 5 AND (contains(n.title, q.name) OR starts_with(n.bare, q.name)) WHERE q.kind <> 'case' AND q.name <> '' GROUP BY q.ref)
SELECT q.ref, coalesce(c.id, own.id, named.id) AS case_id FROM q LEFT JOIN cases c ON c.id = q.s LEFT JOIN own ON own.canon_id = q.cid LEFT JOIN named ON named.ref = q.ref""",
    "r6_cases": f"""WITH {_SMALL}, {sql.PAGES}, s AS (SELECT source AS id, target, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS k FROM edges WHERE type = 'MENTIONS_STATUTE'), l AS (SELECT id, string_agg(target || ' x' || n, '; ' ORDER BY k) AS statutes FROM s WHERE k <= 15 GROUP BY id),
o AS (SELECT source AS id, count(*) AS n FROM edges WHERE type = 'CITES' GROUP BY source), i AS (SELECT target AS id, count(*) AS n FROM edges WHERE type = 'CITES' GROUP BY target), p AS (SELECT case_id AS id, count(*) AS n FROM pages GROUP BY case_id)
SELECT c.id, coalesce(p.n, 0) AS n_pages, coalesce(o.n, 0) AS n_cites, coalesce(i.n, 0) AS n_cited_by, coalesce(l.statutes, '') AS statutes FROM cases c LEFT JOIN p USING (id) LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN l USING (id)""",
    "r7_page": f"WITH {sql.PAGES} SELECT case_id, page, text FROM pages WHERE page = 1",
    "r8_dense": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(e.v, e.v)) AS x FROM e q JOIN e ON true WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, vec_id)::INT AS rank, vec_id, round(x, 4) AS score FROM s) SELECT * FROM r WHERE rank <= 8""",
    "g3_active_parts": f"""WITH {sql.PAGES}, s AS (SELECT DISTINCT case_id, seg_id, part_name, start_page, start_char FROM segments), j AS (SELECT p.case_id, p.page, s.part_name AS part, s.seg_id, row_number() OVER (PARTITION BY p.case_id, p.page ORDER BY s.start_page DESC NULLS LAST, s.start_char DESC) AS k
FROM pages p LEFT JOIN s ON s.case_id = p.case_id AND (s.start_page < p.page OR s.start_page = p.page AND s.start_char <= 0)) SELECT case_id, page, part, seg_id FROM j WHERE k = 1""",
    "g3_annotated": f"""WITH {sql.PAGES}, s AS (SELECT DISTINCT case_id, start_page AS page, start_char, chr(10) || '<<<PART BEGINS: ' || part_name || ' | ' || label || ' | seg_id=' || seg_id || '>>>' || chr(10) AS mark FROM segments),
o AS (SELECT p.case_id, p.page, p.text, s.start_char, s.mark, lead(s.start_char) OVER (PARTITION BY p.case_id, p.page ORDER BY s.start_char, s.mark) AS following FROM pages p JOIN s USING (case_id, page)),
g AS (SELECT case_id, page, substring(any_value(text), 1, min(start_char)) || string_agg(mark || substring(text, start_char + 1, coalesce(following, length(text)) - start_char), '' ORDER BY start_char, mark) AS text FROM o GROUP BY case_id, page)
SELECT p.case_id, p.page, coalesce(g.text, p.text) AS text FROM pages p LEFT JOIN g USING (case_id, page)""",
    "g7_contexts": f"""WITH {sql.PAGES}, m AS (SELECT case_id, page, '===== [[PAGE ' || page || ']] =====' || chr(10) || text AS t FROM pages)
SELECT case_id, page, substring(array_to_string(list_filter([lag(t) OVER w, t, lead(t) OVER w], lambda x: x IS NOT NULL), chr(10)), 1, 9000) AS context FROM m WINDOW w AS (PARTITION BY case_id ORDER BY page)""",
}
