"""Queries over quotations and answers (V), evaluation (M, E) and ledgers (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import span_iou, span_overlap
from docketry.operators import answers, evaluation, ledger, quotes
from docketry.plans import sql
from docketry.plans.graph import all_pages, cited, known_cases
from docketry.sources.tables import checkpointed, table


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """A passage of each page, stated to be on it, on the next or on the one after that in turn."""
    return all_pages(spark, d).filter(F.length("text") > 130).select(F.concat_ws("#", "case_id", F.col("page").cast("string")).alias("quote_id"), "case_id", (F.col("page") + F.col("page") % 3).alias("page"), F.substring("text", 40, 90).alias("quote"))


def v1_page_keys(spark: SparkSession, d: str) -> DataFrame:
    return quotes.page_keys(all_pages(spark, d)).select("case_id", "page", "start", "end")


def v2_located(spark: SparkSession, d: str) -> DataFrame:
    """Where each passage is found; -1 for nowhere."""
    found = quotes.located(_quotes(spark, d), all_pages(spark, d))
    return found.select("quote_id", "case_id", "page", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("found_page", "found_start", "found_end")])


def v3_items(spark: SparkSession, d: str) -> DataFrame:
    """Each case as one item whose evidence are its passages."""
    found = quotes.located(_quotes(spark, d), all_pages(spark, d)).withColumn("confidence", F.lit(0.9))
    return quotes.verified_items(found, "case_id")


def v4_checked(spark: SparkSession, d: str) -> DataFrame:
    return quotes.checked_quotes(_quotes(spark, d), all_pages(spark, d)).select("quote_id", "quote_match", "matched_page", "page_note")


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as drafts: the turn numbered n cites passages of the sources of the matches numbered n and n + 1."""
    t = table(spark, d, "turns").select(F.col("turn_id").alias("draft_id"), F.col("text").alias("answer")).distinct()
    t = t.withColumn("n", F.conv(F.substring("draft_id", 2, 20), 10, 10).cast("bigint"))
    m = table(spark, d, "matches").filter("source IS NOT NULL").select("match_id", F.col("source").alias("case_id")).distinct().withColumn("n", F.conv(F.substring("match_id", 2, 20), 10, 10).cast("bigint"))
    m = m.join(_quotes(spark, d).groupBy("case_id").agg(F.min(F.struct("page", "quote")).alias("q")).select("case_id", "q.*"), "case_id", "left")
    rows = t.select("draft_id", "answer", F.explode(F.array("n", F.col("n") + 1)).alias("n")).join(m, "n", "left")
    cite = F.when(F.col("match_id").isNotNull(), F.struct("n", F.struct(F.col("case_id").alias("case"), "quote", F.col("page").cast("int").alias("page")).alias("c")))
    by = rows.groupBy("draft_id", "answer").agg(F.array_sort(F.collect_list(cite)).alias("c"))
    return by.select("draft_id", "answer", F.transform("c", lambda x: x["c"]).alias("citations"))


def v5_citations(spark: SparkSession, d: str) -> DataFrame:
    return answers.verified_citations(drafts(spark, d), known_cases(spark, d), all_pages(spark, d))


def v7_problems(spark: SparkSession, d: str) -> DataFrame:
    rows, pages = checkpointed(drafts(spark, d)), all_pages(spark, d)
    return answers.answer_problems(rows, checkpointed(answers.verified_citations(rows, known_cases(spark, d), pages)), pages)


def v8_quotes(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_quotes(drafts(spark, d)).select("draft_id", "quote_no", "quote", F.array_join("markers", ",").alias("markers"), "full")


def v10_salvaged(spark: SparkSession, d: str) -> DataFrame:
    rows, pages = checkpointed(drafts(spark, d)), all_pages(spark, d)
    found = checkpointed(answers.verified_citations(rows, known_cases(spark, d), pages))
    return answers.salvaged(rows, found, checkpointed(answers.answer_problems(rows, found, pages)))


def v11_reports(spark: SparkSession, d: str) -> DataFrame:
    rows, pages = checkpointed(drafts(spark, d)), all_pages(spark, d)
    found = checkpointed(answers.verified_citations(rows, known_cases(spark, d), pages))
    return answers.answer_reports(rows, found, checkpointed(answers.answer_problems(rows, found, pages)))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """All segments as gold items of their case, with offsets counted through its pages in order."""
    s = table(spark, d, "segments").select("case_id", "seg_id", "part_name", "label", "start_page", "start_char", "end_page", "end_char").distinct()
    pages = all_pages(spark, d).select(F.col("case_id").alias("c"), "page", F.length("text").alias("n"))
    before = [F.coalesce(F.sum(F.when(F.col("page") < F.col(of), F.col("n"))), F.lit(0)).alias(to) for of, to in (("start_page", "start_base"), ("end_page", "end_base"))]
    s = s.join(pages, (F.col("case_id") == F.col("c")) & (F.col("page") < F.col("end_page")), "left").groupBy(*s.columns).agg(*before)
    return _gold_items(s, F.col("start_base") + F.col("start_char"), F.col("end_base") + F.col("end_char"))


def _gold_items(s: DataFrame, start: Column, end: Column) -> DataFrame:
    span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    return s.select(F.col("case_id").alias("unit_id"), F.col("seg_id").alias("id"), F.col("part_name").alias("type"), "label", F.lit(None).cast("string").alias("summary"), span.alias("spans"), F.lit("llm").alias("provenance"), "start_char", "end_char")


def pred(items: DataFrame) -> DataFrame:
    """Gold items with a fifth left out, spans moved and some types changed."""
    span = F.col("spans")[0]
    moved = F.array(F.struct((span["start"] + F.col("start_char") % 7).cast("int").alias("start"), span["end"].alias("end")))
    kind = F.when(F.col("start_char") % 11 == 3, "other").otherwise(F.col("type"))
    state = F.when(F.col("start_char") % 13 == 1, "unverified").otherwise("llm")
    return items.filter("start_char % 5 <> 1").withColumns({"spans": moved, "type": kind, "provenance": state})


def m1_scores(spark: SparkSession, d: str) -> DataFrame:
    q = gold(spark, d)
    return evaluation.node_scores(pred(q), q, 0.3).withColumn("score", F.round("score", 6))


def m2_matched(spark: SparkSession, d: str) -> DataFrame:
    q = gold(spark, d)
    return evaluation.matched(evaluation.node_scores(pred(q), q, 0.3))


def m5_evaluated(spark: SparkSession, d: str) -> DataFrame:
    q = checkpointed(gold(spark, d))
    p = pred(q)
    items = evaluation.outcomes(p, q, evaluation.matched(evaluation.node_scores(p, q, 0.3)), ["type"])
    return evaluation.scores(items, ["type"])


def m5_macro(spark: SparkSession, d: str) -> DataFrame:
    q = checkpointed(gold(spark, d))
    p = pred(q)
    return evaluation.macro_scores(evaluation.outcomes(p, q, evaluation.matched(evaluation.node_scores(p, q, 0.3)), ["type"]))


def m6_sweep(spark: SparkSession, d: str) -> DataFrame:
    q = checkpointed(gold(spark, d))
    return evaluation.threshold_sweep(pred(q), q)


def m7_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Matches against detected citations across domains."""
    a = table(spark, d, "matches").filter("source IS NOT NULL AND target IS NOT NULL").select(F.lit("CITES").alias("type"), "source", "target")
    return evaluation.tier_scores(a, cited(spark, d).filter("scope = 'cross_domain'").select(F.lit("CITES").alias("type"), "source", "target"))


def m8_errors(spark: SparkSession, d: str) -> DataFrame:
    q = checkpointed(gold(spark, d))
    p = pred(q)
    strict, loose = (evaluation.matched(evaluation.node_scores(p, q, 0.3, relaxed=r)) for r in (False, True))
    return evaluation.node_errors(p, q, strict, loose)


def m9_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.error_summary(m8_errors(spark, d), ["unit_id", "side", "id"])


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Turns scored as answers to one question each: expected are a turn's tools (as names of cases), cited all but the first of them
    and the system, or none; what is expected of the answer follows the number of revisions."""
    t = table(spark, d, "turns").dropDuplicates(["turn_id"])
    none = F.array().cast("array<string>")
    cited = F.when((F.col("revisions") == 1) & (F.col("output_tokens") % 2 == 0), none).otherwise(F.concat(F.slice(F.coalesce("tools", none), 2, 99), F.array("system")))
    turns = t.select(F.col("turn_id").alias("id"), "system", "status", F.when(F.col("output_tokens") % 3 == 0, F.concat_ws(" ", "text", F.lit("Disclaimer: none"))).otherwise(F.col("text")).alias("text"), cited.alias("cited"), "tools", "latency_s", "input_tokens", "output_tokens", "model_calls", F.col("model_calls").alias("n_unverified"))
    expect = F.when(F.col("revisions") == 0, "answer").when(F.col("revisions") == 1, "refuse").otherwise("disclaimer")
    golden = t.select(F.col("turn_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("category"), expect.alias("expect"), F.col("tools").alias("expected_cases"), F.array(F.lit("verify")).alias("needs_tools"))
    return evaluation.scored_turns(turns, golden, allowed_tools=("find_citing", "search_cases", "verify_answer", "get_page", "search_pages"), verify_tool="verify_answer")


def m10_cited(spark: SparkSession, d: str) -> DataFrame:
    """The cases that each draft cites: verified, and referred to by a marker."""
    rows = checkpointed(drafts(spark, d))
    found = answers.cited_cases(rows, answers.verified_citations(rows, known_cases(spark, d), all_pages(spark, d)))
    return found.select("draft_id", F.array_join("cited", ",").alias("cited"))


def m11_scored(spark: SparkSession, d: str) -> DataFrame:
    flags = ["behaviour_ok", "needs_tools_ok", "only_allowed_tools", "self_verified", "tool_calls"]
    return scored(spark, d).select("id", "system", "category", "recall", "precision", F.array_join("missed", ",").alias("missed"), *flags)


def m12_turns(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.turn_aggregate(scored(spark, d).withColumn("n_status_claims", F.col("tool_calls")), 0.0214, 0.5)


def e3_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each case with those of the same part and label merged."""
    g = gold(spark, d).select(F.col("unit_id").alias("case_id"), F.row_number().over(Window.partitionBy("unit_id").orderBy("id")).alias("item"), "type", "label", "spans")
    return evaluation.deduplicated(g)


def e4_ids(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "segments").select("case_id", F.col("part_name").alias("type"), F.lit("part").alias("label"), "seg_id").distinct()
    return evaluation.assigned_ids(g, "seg_id").select("seg_id", "id")


def f13_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's span, moved by a third of its length, against itself."""
    start, end = F.col("spans")[0]["start"], F.col("spans")[0]["end"]
    moved = F.floor((end - start) / 3)
    at = [start, end, start + moved, end + moved]
    return gold(spark, d).select(F.col("id").alias("seg_id"), F.round(span_iou(*at), 6).alias("iou"), F.round(span_overlap(*at), 6).alias("overlap"))


def e6_progress(spark: SparkSession, d: str) -> DataFrame:
    """Units by how far their replies are, where segments stand for replies."""
    units = table(spark, d, "units").select(F.col("case_id").alias("unit_id"))
    replies = table(spark, d, "segments").select(F.col("case_id").alias("unit_id"), F.when(F.col("part_name") == "majority", "edges").otherwise("nodes").alias("stage"), F.when(F.col("end_char") % 10 == 0, "length").otherwise("stop").alias("finish_reason")).distinct()
    return evaluation.unit_progress(units, replies).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def t1_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.quota_used(table(spark, d, "events"), "user_id", "ts", {"minute": 2, "hour": 3, "day": 6})
    return rows.select("event_id", "used_minute", "used_hour", "used_day", F.round("wait_hour", 3).alias("wait_hour"), "blocked_by")


def t4_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last day of the ledger, by user."""
    e = table(spark, d, "events")
    kept = ledger.pruned(e, "ts", e.select(F.max("ts")).scalar())
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def t5_digests(spark: SparkSession, d: str) -> DataFrame:
    """Sessions' digests, where a turn's tools stand for the cases that it discussed."""
    t = table(spark, d, "turns").dropDuplicates(["turn_id"])
    cases = F.transform("tools", lambda x: F.struct(x.alias("title"), F.lit(None).cast("string").alias("case_id"), F.col("question_id").alias("citation")))
    return ledger.session_digest(t.withColumn("cases", cases), "session", "turn_id", "asked_at", "question_id", "text", "cases")


def t6_tools(spark: SparkSession, d: str) -> DataFrame:
    return ledger.tool_stats(table(spark, d, "turns").dropDuplicates(["turn_id"]), "turn_id")


def t6_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return ledger.trajectory_stats(table(spark, d, "turns").dropDuplicates(["turn_id"]), "system")


def t7_tally(spark: SparkSession, d: str) -> DataFrame:
    """Largest values by type of event and by day, summed by user."""
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.to_date("ts").alias("day"))
    return ledger.token_tally(e, "user_id", "event_type", "value", "day").select("user_id", F.round("tokens", 4).alias("tokens"))


def t9_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first five events of each user."""
    return ledger.within_budget(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "n_call")


QUERIES = {
    f.__name__: f
    for f in (v1_page_keys, v2_located, v3_items, v4_checked, v5_citations, v7_problems, v8_quotes, v10_salvaged, v11_reports, m1_scores, m2_matched, m5_evaluated, m5_macro, m6_sweep, m7_tiers, m8_errors, m9_summary, m10_cited, m11_scored, m12_turns, e3_deduplicated, e4_ids, f13_spans, e6_progress, t1_quota, t4_pruned, t5_digests, t6_tools, t6_trajectories, t7_tally, t9_budget)
}

_KEYS = f"""{sql.PAGES}, k AS (SELECT case_id, page, {sql.match_key("text")} AS key FROM pages), keys AS (SELECT case_id, page, key, (sum(length(key)) OVER w)::BIGINT AS e, coalesce(lead(key) OVER w, '') AS after, coalesce(lag(key) OVER w, '') AS before, lag(page) OVER w AS page_before, lead(page) OVER w AS page_after FROM k WINDOW w AS (PARTITION BY case_id ORDER BY page))"""
_QUOTES = f"""q AS (SELECT case_id || '#' || page AS quote_id, case_id, page + page % 3 AS page, substring(text, 40, 90) AS quote, regexp_replace({sql.match_key("substring(text, 40, 90)")}, '^[.,;:]+|[.,;:]+$', '', 'g') AS piece FROM pages WHERE length(text) > 130)"""
_LOCATED = f"""{_KEYS}, {_QUOTES}, h AS (SELECT q.*, keys.page AS own_page, page_before, page_after, length(key) AS n, e - length(key) AS s, length(before) AS nb, strpos(key || after, piece) AS here, strpos(before || key || after, piece) AS back FROM q LEFT JOIN keys ON keys.case_id = q.case_id AND keys.page = q.page),
l AS (SELECT *, CASE WHEN length(piece) < 12 THEN NULL WHEN here > 0 THEN s + here - 1 WHEN back > 0 THEN s - nb + back - 1 END AS f FROM h)"""
_GOLD = f"""{sql.PAGES}, g0 AS (SELECT DISTINCT case_id, seg_id, part_name, label, start_page, start_char, end_page, end_char FROM segments),
gold AS (SELECT g0.case_id AS unit_id, seg_id AS id, part_name AS type, label, start_char AS c, (start_char + coalesce(sum(length(p.text)) FILTER (p.page < start_page), 0))::INT AS s, (end_char + coalesce(sum(length(p.text)) FILTER (p.page < end_page), 0))::INT AS e
FROM g0 LEFT JOIN pages p ON p.case_id = g0.case_id GROUP BY g0.case_id, seg_id, part_name, label, start_page, start_char, end_page, end_char),
pred AS (SELECT unit_id, id, CASE WHEN c % 11 = 3 THEN 'other' ELSE type END AS type, label, (s + c % 7)::INT AS s, e FROM gold WHERE c % 5 <> 1)"""
_T = "t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY loaded_at) = 1)"
_SCORED = """s0 AS (SELECT turn_id AS id, system, status, latency_s, input_tokens, output_tokens, model_calls, tools, revisions, coalesce(lang, 'none') AS category, coalesce(CASE WHEN output_tokens % 3 = 0 THEN concat_ws(' ', text, 'Disclaimer: none') ELSE text END, '') AS text, list_distinct(coalesce(tools, [])) AS e,
CASE WHEN revisions = 1 AND output_tokens % 2 = 0 THEN [] ELSE list_distinct(list_concat(list_slice(coalesce(tools, []), 2, 99), [system])) END AS c FROM t),
scored AS (SELECT *, CASE WHEN len(e) > 0 THEN round(len(list_intersect(e, c)) / len(e), 3) END AS recall, CASE WHEN len(e) > 0 AND len(c) > 0 THEN round(len(list_intersect(e, c)) / len(c), 3) END AS precision, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(c, x))), ',') AS missed,
CASE revisions WHEN 0 THEN status IN ('verified', 'salvaged') WHEN 1 THEN len(c) = 0 ELSE contains(text, 'Disclaimer:') END AS behaviour_ok, CASE WHEN tools IS NOT NULL THEN len(list_filter(tools, lambda x: contains(x, 'verify'))) > 0 END AS needs_tools_ok,
CASE WHEN tools IS NOT NULL THEN NOT list_contains(tools, 'most_cited') END AS only_allowed_tools, CASE WHEN tools IS NOT NULL THEN list_contains(tools, 'verify_answer') END AS self_verified, len(tools)::INT AS tool_calls FROM s0)"""
_LABELS = "list_distinct(regexp_extract_all(lower(coalesce({0}.label, '')), '[a-z0-9]+'))"

ORACLES = {
    "v1_page_keys": f"WITH {_KEYS} SELECT case_id, page, e - length(key) AS start, e AS \"end\" FROM keys",
    "v2_located": f"WITH {_LOCATED} SELECT quote_id, case_id, page, CASE WHEN f IS NULL THEN -1 WHEN f < s THEN page_before WHEN f >= s + n THEN page_after ELSE own_page END AS found_page, coalesce(f, -1) AS found_start, coalesce(f + length(piece), -1) AS found_end FROM l",
    "v3_items": f"""WITH {_LOCATED}, g AS (SELECT case_id, count(*) AS n_quotes, count(f) AS n_verified, max(CASE WHEN f IS NOT NULL THEN len(string_split_regex(trim(quote), '\\s+')) END) AS longest FROM l GROUP BY case_id)
SELECT case_id, CASE WHEN n_verified > 0 THEN 'llm' ELSE 'unverified' END AS provenance, round(CASE WHEN n_verified = 0 THEN 0.3::DOUBLE WHEN n_verified < n_quotes THEN 0.72::DOUBLE ELSE 0.9::DOUBLE END, 4) AS confidence, CASE WHEN n_verified >= 2 OR longest >= 15 THEN 'strong' WHEN n_verified = 1 THEN 'moderate' ELSE 'weak' END AS evidence_strength, n_verified, n_quotes FROM g""",
    "v4_checked": f"""WITH {_KEYS}, {_QUOTES}, h AS (SELECT q.quote_id, q.page, keys.page AS at_page, page_before, page_after, length(key) AS n, CASE WHEN strpos(key || after, piece) > 0 THEN strpos(key || after, piece) - 1 WHEN strpos(before || key || after, piece) > 0 THEN strpos(before || key || after, piece) - 1 - length(before) END AS f
FROM q JOIN keys ON keys.case_id = q.case_id WHERE length(piece) >= 12), w AS (SELECT quote_id, arg_min(CASE WHEN f < 0 THEN page_before WHEN f >= n THEN page_after ELSE at_page END, CASE WHEN at_page = page THEN 0 ELSE at_page END) AS matched_page FROM h WHERE f IS NOT NULL GROUP BY quote_id)
SELECT q.quote_id, w.matched_page IS NOT NULL AS quote_match, w.matched_page, CASE WHEN w.matched_page <> q.page THEN 'quote found on page ' || w.matched_page || ', not ' || q.page END AS page_note FROM q LEFT JOIN w USING (quote_id)""",
    "m1_scores": f"""WITH {_GOLD}, j AS (SELECT p.unit_id, p.id AS pred_id, g.id AS gold_id, {_LABELS.format("p")} AS a, {_LABELS.format("g")} AS b, least(p.e, g.e) - greatest(p.s, g.s) AS shared, greatest(p.e, g.e) - least(p.s, g.s) AS hull FROM pred p JOIN gold g ON p.unit_id = g.unit_id AND p.type = g.type),
s AS (SELECT unit_id, pred_id, gold_id, 0.8::DOUBLE * CASE WHEN shared > 0 THEN shared / hull ELSE 0 END + 0.2::DOUBLE * CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS score FROM j) SELECT unit_id, pred_id, gold_id, round(score, 6) AS score FROM s WHERE score >= 0.3::DOUBLE""",
    "m7_tiers": f"""WITH {sql.CASES}, {sql.CITED}, a AS (SELECT DISTINCT source, target FROM matches WHERE source IS NOT NULL AND target IS NOT NULL), b AS (SELECT DISTINCT source, target FROM cited WHERE scope = 'cross_domain'),
n AS (SELECT (SELECT count(*) FROM a JOIN b USING (source, target)) AS tp, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
SELECT 'CITES' AS type, tp, na - tp AS fp, nb - tp AS fn, round(tp / na, 4) AS p, round(tp / nb, 4) AS r, round(CASE WHEN tp > 0 THEN 2 * (tp / na) * (tp / nb) / (tp / na + tp / nb) ELSE 0 END, 4) AS f1 FROM n""",
    "m11_scored": f"WITH {_T}, {_SCORED} SELECT id, system, category, recall, precision, missed, behaviour_ok, needs_tools_ok, only_allowed_tools, self_verified, tool_calls FROM scored",
    "m12_turns": f"""WITH {_T}, {_SCORED}, c AS (SELECT *, (coalesce(input_tokens, 0) * 0.0214::DOUBLE + coalesce(output_tokens, 0) * 0.5::DOUBLE) / 1e6 AS cost1 FROM scored)
SELECT system, CASE WHEN grouping(category) = 1 THEN '(all)' ELSE category END AS category, count(*) AS n, round(avg(recall), 3) AS recall, round(avg(precision), 3) AS precision, round(avg(behaviour_ok::INT), 3) AS behaviour_ok, round(avg(needs_tools_ok::INT), 3) AS needs_tools_ok,
round(avg(only_allowed_tools::INT), 3) AS only_allowed_tools, round(avg(self_verified::INT), 3) AS self_verified, round(avg((status IN ('verified', 'salvaged'))::INT), 3) AS answered, sum(coalesce(tool_calls, 0))::BIGINT AS status_claims, sum(model_calls)::BIGINT AS unverified_citations,
round(avg(latency_s), 1) AS latency_mean, round(quantile_cont(latency_s, 0.5), 1) AS latency_p50, round(max(latency_s), 1) AS latency_max, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(model_calls, 0))::BIGINT AS model_calls,
count(*) FILTER (coalesce(output_tokens, 0) > 0 AND coalesce(input_tokens, 0) = 0) AS input_missing, round(avg(cost1), 6) AS cost, round(sum(cost1), 4) AS cost_total FROM c GROUP BY GROUPING SETS ((system), (system, category))""",
    "f13_spans": f"WITH {_GOLD}, a AS (SELECT id AS seg_id, s AS s1, e AS e1, floor((e - s) / 3)::INT AS m FROM gold) SELECT seg_id, round(CASE WHEN e1 - s1 - m > 0 THEN (e1 - s1 - m) / (e1 + m - s1) ELSE 0 END, 6) AS iou, round(CASE WHEN e1 - s1 - m > 0 AND e1 > s1 THEN (e1 - s1 - m) / (e1 - s1) ELSE 0 END, 6) AS overlap FROM a",
    "e4_ids": """WITH g AS (SELECT DISTINCT case_id, part_name, seg_id FROM segments), b AS (SELECT seg_id, case_id || ':' || part_name || ':part' AS base, row_number() OVER (PARTITION BY case_id, part_name ORDER BY seg_id) AS n FROM g) SELECT seg_id, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS id FROM b""",
    "e6_progress": """WITH r AS (SELECT DISTINCT case_id, CASE WHEN part_name = 'majority' THEN 'edges' ELSE 'nodes' END AS stage, end_char % 10 <> 0 AS whole FROM segments), b AS (SELECT case_id, count(DISTINCT CASE WHEN whole THEN stage END) AS whole, count(DISTINCT stage) AS there FROM r GROUP BY case_id)
SELECT CASE WHEN b.whole >= 2 THEN 'ok' WHEN b.there >= 2 THEN 'partial' ELSE 'pending' END AS state, count(*) AS n FROM (SELECT DISTINCT case_id FROM units) u LEFT JOIN b USING (case_id) GROUP BY 1""",
    "t1_quota": """WITH w AS (SELECT event_id, ts, count(*) OVER m AS used_minute, count(*) OVER h AS used_hour, count(*) OVER d AS used_day, min(ts) OVER h AS first_hour FROM events
WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW), h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW))
SELECT event_id, used_minute, used_hour, used_day, round(3600 - (epoch_us(ts) - epoch_us(first_hour)) / 1e6, 3) AS wait_hour, CASE WHEN used_day >= 6 THEN 'day' WHEN used_hour >= 3 THEN 'hour' WHEN used_minute >= 2 THEN 'minute' END AS blocked_by FROM w""",
    "t4_pruned": "SELECT user_id, count(*) AS n FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) < 86400000000 GROUP BY user_id",
    "t5_digests": f"""WITH {_T}, r AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY asked_at DESC, turn_id DESC) AS n, *  EXCLUDE session FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC) AS i FROM r WHERE n <= 6),
l AS (SELECT session, i, i || '. Q: ' || coalesce(question_id, '?') || chr(10) || '   Cases discussed: ' || coalesce(nullif(array_to_string(list_transform(list_slice(coalesce(tools, []), 1, 6), lambda x: x || ' (' || coalesce(question_id, '') || ')'), ', '), ''), 'none') || chr(10) || '   Answer summary: ' || substring(regexp_replace(coalesce(text, ''), '{sql.BLANK}+', ' ', 'g'), 1, 400) AS line FROM k)
SELECT session, 'Research session ' || chr(39) || session || chr(39) || ' so far (most recent last):' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS digest FROM l GROUP BY session""",
    "t6_tools": f"WITH {_T}, u AS (SELECT turn_id, unnest(tools) AS tool FROM t) SELECT tool, count(*) AS calls, count(DISTINCT turn_id) AS turns FROM u GROUP BY tool",
    "t6_trajectories": f"WITH {_T}, u AS (SELECT system, coalesce(len(tools), 0)::INT AS n FROM t) SELECT system, count(*) AS n_turns, quantile_cont(n, 0.25)::DOUBLE AS q1, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.75)::DOUBLE AS q3, round(avg(n), 6) AS mean, max(n) AS most FROM u GROUP BY system",
    "t7_tally": "WITH a AS (SELECT user_id, sum(m) AS x FROM (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1), b AS (SELECT user_id, sum(m) AS y FROM (SELECT user_id, ts::DATE, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1) SELECT a.user_id, round(greatest(x, y), 4) AS tokens FROM a JOIN b USING (user_id)",
    "t9_budget": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n_call FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5",
}
