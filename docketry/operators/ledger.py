"""Quotas, sessions and trajectories: operators over time-ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The trailing windows of a quota, in seconds.
WINDOWS = {"minute": 60, "hour": 3600, "day": 86400}
#: Turns and cases of each turn that a session's digest keeps, and the length of an answer in it.
DIGEST_TURNS, DIGEST_CASES, DIGEST_CHARS = 6, 6, 400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def quota_used(events: DataFrame, key: str, time: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Events with the number of the key's events in the trailing minute, hour and day (the event itself included; an event
    exactly a span old is out), the exhausted window that is longest (`blocked_by`), and the seconds until each frees.

    Null keys are a key of their own; events without a time are left out.
    """
    limits = limits or {w: 1 << 62 for w in WINDOWS}
    out = events.filter(F.col(time).isNotNull()).withColumn("_t", _micros(time))
    blocked = F.lit(None).cast("string")
    for name, span in WINDOWS.items():
        frame = Window.partitionBy(key).orderBy("_t").rangeBetween(-(span * 1_000_000 - 1), 0)
        out = out.withColumn(f"used_{name}", F.count(F.lit(1)).over(frame)).withColumn(f"wait_{name}", span - (F.col("_t") - F.min("_t").over(frame)) / 1e6)
        blocked = F.when(F.col(f"used_{name}") >= limits[name], name).otherwise(blocked)
    return out.withColumn("blocked_by", blocked).drop("_t")


def pruned(events: DataFrame, time: str, now: Column, keep_s: int = WINDOWS["day"]) -> DataFrame:
    """Events less than `keep_s` seconds before `now`."""
    return events.filter(F.unix_micros(now.cast("timestamp")) - _micros(time) < keep_s * 1_000_000)


def within_budget(calls: DataFrame, run: str, order: list[str], cap: int) -> DataFrame:
    """The first `cap` calls of each run."""
    return calls.withColumn("n_call", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("n_call") <= cap)


def session_digest(turns: DataFrame, session: str, key: str, time: str, question: str, answer: str, cases: str | None = None) -> DataFrame:
    """session, digest: a line with the session's name, then its last six turns, oldest first and numbered, each with its question, up to six cases that it
    discussed (`cases`: array<struct<title, case_id, citation>>; none without such a column) and the start of its answer."""
    last = turns.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(time), F.desc(key)))).filter(F.col("_n") <= DIGEST_TURNS)
    summary = F.substring(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", " "), 1, DIGEST_CHARS)
    named = F.lit("") if cases is None else F.array_join(F.transform(F.slice(F.coalesce(F.col(cases), F.array().cast("array<struct<title: string, case_id: string, citation: string>>")), 1, DIGEST_CASES), lambda c: F.concat(F.coalesce(c["title"], F.lit("")), F.lit(" ("), F.coalesce(c["case_id"], c["citation"], F.lit("")), F.lit(")"))), ", ")
    parts = last.select(session, "_n", F.struct(F.coalesce(question, F.lit("?")).alias("q"), F.when(named == "", "none").otherwise(named).alias("cases"), summary.alias("a")).alias("t"))
    turn = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Q: "), x["t"]["q"], F.lit("\n   Cases discussed: "), x["t"]["cases"], F.lit("\n   Answer summary: "), x["t"]["a"])
    return parts.groupBy(session).agg(F.array_join(F.concat(F.array(F.concat(F.lit("Research session '"), F.first(session), F.lit("' so far (most recent last):"))), F.transform(F.sort_array(F.collect_list(F.struct("_n", "t")), asc=False), turn)), "\n").alias("digest"))


def tool_stats(turns: DataFrame, key: str, tools: str = "tools") -> DataFrame:
    """tool, calls, turns that used it."""
    return turns.select(key, F.explode(tools).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(key).alias("turns"))


def trajectory_stats(turns: DataFrame, by: str, tools: str = "tools") -> DataFrame:
    """Quartiles, mean and maximum of the number of tool calls of each group's turns; null tools are no calls."""
    n = turns.select(by, F.coalesce(F.size(tools), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    at = lambda p: F.percentile("n", F.lit(p))
    return n.groupBy(by).agg(F.count(F.lit(1)).alias("n_turns"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def token_tally(calls: DataFrame, turn: str, message: str, tokens: str, pass_no: str) -> DataFrame:
    """turn, tokens: of each message the largest count (it is reported again as it grows), summed by turn; or the sum of each
    pass's own largest, if that is more."""
    each = calls.groupBy(turn, message).agg(F.max(tokens).alias("t")).groupBy(turn).agg(F.sum("t").alias("by_call"))
    passes = calls.groupBy(turn, pass_no).agg(F.max(tokens).alias("t")).groupBy(turn).agg(F.sum("t").alias("by_pass"))
    return each.join(passes, turn).select(turn, F.greatest("by_call", "by_pass").alias("tokens"))


def paired_spans(events: DataFrame, key: list[str], time: str, kind: str) -> DataFrame:
    """key, started, ended: each end of a tool call with the last start of the same key that has no end yet.

    Starts and ends are numbered by depth, which a running sum gives: an end closes the latest start of its own depth.
    """
    order = Window.partitionBy(*key).orderBy(time, F.when(F.col(kind) == "start", 0).otherwise(1))
    step = F.when(F.col(kind) == "start", 1).otherwise(-1)
    rows = events.withColumn("_after", F.sum(step).over(order)).withColumn("_depth", F.when(F.col(kind) == "start", F.col("_after")).otherwise(F.col("_after") + 1))
    level = Window.partitionBy(*key, "_depth").orderBy(time, F.when(F.col(kind) == "start", 0).otherwise(1))
    rows = rows.withColumn("_before", F.lag(F.struct(F.col(kind).alias("k"), F.col(time).alias("t"))).over(level))
    return rows.filter((F.col(kind) == "end") & (F.col("_depth") > 0) & (F.col("_before.k") == "start")).select(*key, F.col("_before.t").alias("started"), F.col(time).alias("ended"))


def query_cost(input_tokens: Column, output_tokens: Column, input_per_million: float, output_per_million: float) -> Column:
    """The price of a turn; null if a count is."""
    return (input_tokens * F.lit(input_per_million) + output_tokens * F.lit(output_per_million)) / 1e6


def usage_by_turn(usage: DataFrame, messages: DataFrame, turns: DataFrame, tolerance_s: float = 0.05) -> DataFrame:
    """turn_id, input_tokens, output_tokens, matched_by: usage rows (id, latency_s, input_tokens, output_tokens) summed over each
    turn's messages (turn_id, message_id); turns (turn_id, latency_s) without any take the last usage row whose latency differs
    by less than the tolerance. That band join has cells of twice the tolerance as its key, so each row meets three."""
    by_id = usage.join(messages, usage["id"] == messages["message_id"]).groupBy("turn_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).withColumn("matched_by", F.lit("id"))
    rest = turns.join(by_id.select("turn_id"), "turn_id", "left_anti")
    cell = 2 * tolerance_s
    near = rest.select("turn_id", F.col("latency_s").alias("wanted"), F.explode(F.array(*[F.floor(F.col("latency_s") / cell) + i for i in (-1, 0, 1)])).alias("cell"))
    there = usage.select("id", "latency_s", "input_tokens", "output_tokens", F.floor(F.col("latency_s") / cell).alias("cell"))
    hits = near.join(there, "cell").filter(F.abs(F.col("latency_s") - F.col("wanted")) < tolerance_s)
    last = hits.groupBy("turn_id").agg(F.max_by(F.struct("input_tokens", "output_tokens"), "id").alias("u")).select("turn_id", "u.*", F.lit("latency").alias("matched_by"))
    return by_id.unionByName(last)
