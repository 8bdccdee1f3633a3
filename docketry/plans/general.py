"""Queries p1 and p3: uneven keys, and references to records that don't exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.orphans import corpus_orphans, corpus_references, orphan_counts
from docketry.operators.skew import heavy_keys, tree_aggregate
from docketry.sources.tables import table

#: A key with at least this share of its table's rows is reported.
HEAVY_SHARE = 0.02

KEYED = (("matches", "target", "source", "matched_at"), ("mentions", "canon_id", "case_id", "seen_at"))


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct sources or cases, first and last time of each target of matches and each canon_id of mentions."""
    parts = [tree_aggregate(table(spark, d, t), key, member, time).withColumn("tbl", F.lit(t)) for t, key, member, time in KEYED]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys that hold at least 2 % of their table's rows, as delivered."""
    parts = []
    for t, key, member, time in KEYED:
        rows = table(spark, d, t)
        parts.append(heavy_keys(tree_aggregate(rows, key, member, time), rows, HEAVY_SHARE).select(F.lit(t).alias("tbl"), "key_value"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References to no case existing at their time."""
    return corpus_orphans(*(table(spark, d, t) for t in ("matches", "records", "lead_records"))).select("tbl", "field", "row_key", "ref")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and references by table, field and month."""
    m, r, lead = (table(spark, d, t) for t in ("matches", "records", "lead_records"))
    by_id, by_cite = corpus_references(m, r)
    return orphan_counts(corpus_orphans(m, r, lead), by_id.unionByName(by_cite))


QUERIES = {"p1_key_stats": p1_key_stats, "p1_found": p1_found, "p3_found": p3_found, "p3_counts": p3_counts}

_STATS = """SELECT '{t}' AS tbl, {k} AS key_value, count(*) AS n_rows, count(DISTINCT {m}) AS n_members, min({w}) AS first_at, max({w}) AS last_at
FROM {t} GROUP BY {k}"""
_HEAVY = "SELECT '{t}' AS tbl, {k} AS key_value FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) >= 0.02 * (SELECT count(*) FROM {t})"

# Only case forms matter here; statutes and regulations are taken out first, as the canonical order has the decisions before them.
_SQUASHED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_FED = r"F\.\s?(?:2d|3d|4th)|F\.\s?Supp\.(?:\s?[23]d)?|S\.\s?Ct\.|L\.\s?Ed\.(?:\s?2d)?|Fed\.\s?Appx\."
_CASE_ID = rf"""CASE
WHEN regexp_matches(s, '(\d+)\s*I&N\s*Dec\.?\s*(\d+)') THEN 'in_dec:' || regexp_extract(s, '(\d+)\s*I&N\s*Dec\.?\s*(\d+)', 1) || '_' || regexp_extract(s, '(\d+)\s*I&N\s*Dec\.?\s*(\d+)', 2)
WHEN regexp_matches(s, '(\d+)\s*U\.\s*S\.\s*C\.\s*(?:A\.\s*)?§*\s*(\d+[a-z]?)') THEN NULL
WHEN regexp_matches(s, '(\d+)\s*C\.\s*F\.\s*R\.\s*§*\s*(\d+)') THEN NULL
WHEN regexp_matches(s, '(\d+)\s*U\.\s*S\.\s*(\d+)') THEN 'us:' || regexp_extract(s, '(\d+)\s*U\.\s*S\.\s*(\d+)', 1) || '_' || regexp_extract(s, '(\d+)\s*U\.\s*S\.\s*(\d+)', 2)
WHEN regexp_matches(s, '(\d+)\s+({_FED})\s*(\d+)') THEN regexp_replace(lower(regexp_extract(s, '(\d+)\s+({_FED})\s*(\d+)', 2)), '[^a-z0-9]+', '', 'g') || ':' || regexp_extract(s, '(\d+)\s+({_FED})\s*(\d+)', 1) || '_' || regexp_extract(s, '(\d+)\s+({_FED})\s*(\d+)', 3)
END"""
_REFS = f"""spans AS (SELECT id, max(citation) AS citation, min(loaded_at) AS born, max(deleted_at) AS gone FROM (SELECT id, citation, loaded_at, deleted_at FROM records UNION ALL SELECT id, citation, loaded_at, deleted_at FROM lead_records) GROUP BY id),
cited AS (SELECT {_CASE_ID} AS ref, born, gone FROM (SELECT {_SQUASHED.format(c="citation")} AS s, born, gone FROM spans)),
raw AS (SELECT id, min(loaded_at) OVER (PARTITION BY id) AS tm, unnest(citations) AS c FROM records),
by_cite AS (SELECT DISTINCT 'records' AS tbl, 'citations' AS field, id AS row_key, {_CASE_ID} AS ref, tm FROM (SELECT id, tm, {_SQUASHED.format(c="c")} AS s FROM raw)),
by_id AS (SELECT DISTINCT 'matches' AS tbl, 'source' AS field, match_id AS row_key, source AS ref, matched_at AS tm FROM matches UNION SELECT DISTINCT 'matches', 'target', match_id, target, matched_at FROM matches),
refs AS (SELECT * FROM by_cite WHERE ref IS NOT NULL UNION ALL SELECT * FROM by_id WHERE ref IS NOT NULL AND tm IS NOT NULL),
lost AS (SELECT r.* FROM by_id r WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.id = r.ref AND p.born <= r.tm AND (p.gone IS NULL OR r.tm < p.gone))
UNION ALL SELECT r.* FROM by_cite r WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cited p WHERE p.ref = r.ref AND p.born <= r.tm AND (p.gone IS NULL OR r.tm < p.gone)))"""

ORACLES = {
    "p1_key_stats": " UNION ALL ".join(_STATS.format(t=t, k=k, m=m, w=w) for t, k, m, w in KEYED),
    "p1_found": " UNION ALL ".join(_HEAVY.format(t=t, k=k) for t, k, _, _ in KEYED),
    "p3_found": f"WITH {_REFS} SELECT DISTINCT tbl, field, row_key, ref FROM lost",
    "p3_counts": f"""WITH {_REFS}, a AS (SELECT tbl, field, strftime(tm, '%Y-%m') AS month, count(*) AS n_refs FROM refs GROUP BY ALL),
b AS (SELECT tbl, field, strftime(tm, '%Y-%m') AS month, count(*) AS n_orphans FROM lost GROUP BY ALL)
SELECT a.tbl, a.field, a.month, n_refs, coalesce(n_orphans, 0) AS n_orphans FROM a LEFT JOIN b USING (tbl, field, month)""",
}
