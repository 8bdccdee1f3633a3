"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from docketry.functions.text import STOP_WORDS

# RE2 knows no Unicode blanks by \s, so they are listed.
BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FED = r"F\.\s?(?:2d|3d|4th)|F\.\s?Supp\.(?:\s?[23]d)?|S\.\s?Ct\.|L\.\s?Ed\.(?:\s?2d)?|Fed\.\s?Appx\."


def squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"


def match_key(c: str) -> str:
    dropped = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\-\x{ad}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2032}\x{2033}\x{fffd}''\"`]+"
    return rf"regexp_replace(regexp_replace({c}, '<<<PART BEGINS:[^>]*>>>|=====\s*\[\[PAGE[^\]]*\]\]\s*=====', '', 'g'), '{dropped}', '', 'g')"


def tokens(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), lambda w: length(w) > 1 AND w NOT IN ({stop}))"


def slug(c: str, n: int = 60) -> str:
    cut = f"regexp_replace(substring(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, {n}), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {cut} = '' THEN 'x' ELSE {cut} END"


def canon(s: str, part: str) -> str:
    """The id, kind or display of the citation in `s`, a squashed string."""
    forms = [
        (r"(\d+)\s*I&N\s*Dec\.?\s*(\d+)", "case", "'in_dec:' || {0} || '_' || {1}", "{0} || ' I&N Dec. ' || {1}"),
        (r"(\d+)\s*U\.\s*S\.\s*C\.\s*(?:A\.\s*)?§*\s*(\d+[a-z]?)", "statute", "'usc:' || {0} || '_' || lower({1})", "{0} || ' U.S.C. § ' || {1}"),
        (r"(\d+)\s*C\.\s*F\.\s*R\.\s*§*\s*(\d+)", "regulation", "'cfr:' || {0} || '_' || {1}", "{0} || ' C.F.R. Part ' || {1}"),
        (r"(\d+)\s*U\.\s*S\.\s*(\d+)", "case", "'us:' || {0} || '_' || {1}", "{0} || ' U.S. ' || {1}"),
        (rf"(\d+)\s+({FED})\s*(\d+)", "case", "regexp_replace(lower({1}), '[^a-z0-9]+', '', 'g') || ':' || {0} || '_' || {2}", "{0} || ' ' || {1} || ' ' || {2}"),
    ]
    other = {"id": f"'other:' || substring(regexp_replace(regexp_replace(lower({s}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60)", "kind": "'other'", "display": s}[part]
    out = [f"CASE WHEN {s} IS NULL THEN NULL"]
    for p, kind, made, display in forms:
        value = {"id": made, "kind": f"'{kind}'", "display": display}[part]
        out.append(f"WHEN regexp_matches({s}, '{p}') THEN " + value.format(*[f"regexp_extract({s}, '{p}', {i})" for i in (1, 2, 3)]))
    return " ".join(out) + f" ELSE {other} END"


CASES = f"""cases0 AS (SELECT id, arg_min(domain, loaded_at) AS domain, arg_min(title, loaded_at) AS title, min(citation) AS citation, coalesce(min(court), min(issuing_body)) AS court
FROM (SELECT id, domain, title, citation, court, issuing_body, loaded_at FROM records UNION ALL SELECT id, domain, title, citation, court, issuing_body, loaded_at FROM lead_records) GROUP BY id),
cases AS (SELECT id, domain, title, citation, court, CASE WHEN trim(coalesce(citation, '')) = '' THEN 'nocite:' || id ELSE {canon(squash("citation"), "id")} END AS canon_id FROM cases0)"""

CITED = f"""own AS (SELECT canon_id, max(id) AS target FROM cases WHERE canon_id NOT LIKE 'nocite:%' GROUP BY canon_id),
listed AS (SELECT DISTINCT id, domain, citations FROM records),
raw AS (SELECT id AS source, domain, unnest(citations) AS raw FROM listed),
cited0 AS (SELECT source, domain, {canon(squash("raw"), "id")} AS canon_id, {canon(squash("raw"), "kind")} AS kind FROM raw),
cited AS (SELECT DISTINCT c.source, coalesce(o.target, 'auth:' || c.canon_id) AS target, CASE WHEN o.target IS NULL THEN 'external' WHEN t.domain = c.domain THEN 'internal' ELSE 'cross_domain' END AS scope
FROM cited0 c JOIN cases s ON s.id = c.source LEFT JOIN own o ON o.canon_id = c.canon_id LEFT JOIN cases t ON t.id = o.target WHERE c.kind = 'case' AND c.canon_id <> s.canon_id)"""

PAGES = """pages AS (SELECT case_id, e.key AS page, max(e.value) AS text FROM (SELECT case_id, unnest(map_entries(raw_pages)) AS e FROM units) WHERE e.value IS NOT NULL GROUP BY case_id, e.key)"""

MATCHED = """matched AS (SELECT DISTINCT match_id, source, target, basis, page, quote FROM matches WHERE source IS NOT NULL AND target IS NOT NULL)"""


def pagerank(nodes: str, links: str, rounds: int) -> str:
    """CTEs ranks0 to ranks<rounds> (id, rank) for CTEs `nodes` (id) and `links` (source, target)."""
    out = [f"deg AS (SELECT source, count(*) AS degree FROM {links} GROUP BY source)", f"ranks0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {nodes}) AS rank FROM {nodes})"]
    for i in range(rounds):
        out.append(f"flow{i} AS (SELECT l.target AS id, sum(r.rank / d.degree) AS flow FROM {links} l JOIN deg d USING (source) JOIN ranks{i} r ON r.id = l.source GROUP BY l.target)")
        idle = f"(SELECT coalesce(sum(rank), 0) FROM ranks{i} WHERE id NOT IN (SELECT source FROM {links}))"
        out.append(f"ranks{i + 1} AS (SELECT r.id, 0.15::DOUBLE / (SELECT count(*) FROM {nodes}) + 0.85::DOUBLE * {idle} / (SELECT count(*) FROM {nodes}) + 0.85::DOUBLE * coalesce(f.flow, 0) AS rank FROM ranks{i} r LEFT JOIN flow{i} f USING (id))")
    return ",\n".join(out)
