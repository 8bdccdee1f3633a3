"""The gate that drafted answers pass: citations resolved, quotes found, claims cited; and what is kept of those that fail."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.citations import canon
from docketry.functions.text import match_key
from docketry.operators.quotes import altered_quotes, checked_quotes
from docketry.operators.search import resolve
from docketry.sources.tables import checkpointed

VERIFIED, EXTERNAL, UNVERIFIED = "verified_in_corpus", "resolved_externally", "unverified"
STATUS_LABEL = "not verified; may have subsequent treatment"

# The patterns by which sentences of an answer are judged.
MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"
STATUS_CLAIM = (
    r"(?i)\b(still|remains?|is|continues to be)\s+(good|valid|binding|controlling)\s+(law|precedent)\b"
    r"|\bhas\s+(not|never)\s+been\s+(overruled|abrogated|reversed|superseded)\b|\bis\s+(no longer|not)\s+good\s+law\b"
)
STATUS_QUALIFIER = r"(?i)not (been )?verified|unverified|cannot (be )?(confirm|verif)|no citator"
LEGAL_CUES = (
    r"(?i)\b(held|holds|holding|ruled|rules|concluded|decided|found|determined|reasoned|applied|applies|distinguished|overruled|affirmed|reversed|remanded|"
    r"dismissed|sustained|requires?|eligib\w*|removab\w*|inadmissib\w*|deportab\w*|statute|section|§|U\.\s?S\.\s?C|I&N|Board|Court|Attorney General|Congress|INA)\b|§"
)
CASE_CITE = r"\b\d{1,3}\s+(?:I&N\s*Dec\.|U\.\s?S\.|S\.\s?Ct\.|F\.\s?(?:2d|3d|4th)|F\.\s?Supp\.)\s*\d{1,4}\b"
EXEMPT = r"(?i)^\s*(#|\*\*?(provenance|sources|citations|disclaimer)|provenance|sources?:|disclaimer|note:|this is (legal )?research|i (could|did) not find|no (case|result))"
HEADING_VERBS = r"(?i)(held|holds|holding|ruled|rules|concluded|decided|found|determined|granted|denied|affirmed|reversed|remanded|overruled|must|requires?|is|are|was|were)"
ADVICE = (
    r"(?i)\b(should I|should my|can I|could I|am I|will I|do I (need|have)|my (case|client|application|hearing|visa|green card|status|removal|deportation|asylum|petition|options)|"
    r"what are my|what should|advise|advice|best (strategy|option)|chances|likely to (win|succeed)|my (husband|wife|son|daughter|father|mother))\b"
)
QUOTED = r"\"([^\"\n]+)\"|“([^“”\n]+)”|«([^«»\n]+)»|(?<!\w)['‘]([^'‘’\n]{12,}?)['’](?!\w)"
NAME_STOP = ("matter", "united", "states", "the", "and", "rel.")
PROTECTED = r"\b(v|U\.S|Dec|No|Nos|Cir|Inc|Co|Corp|Stat|Supp|App|art|cf|e\.g|i\.e|etc|seq|Ct|Ed|Fed|F|S|L)\."
QUOTE_LEAST, QUOTATION_LEAST = 3, 5

_MARKER, _QUOTED, _CASE_CITE = re.compile(MARKER), re.compile(QUOTED), re.compile(CASE_CITE)


# Fixed value: what the text of a provider's failure says.
PROVIDER_ERROR = r"(?i)API Error|Request rejected \(429\)|HTTP 429|usage limit|rate.?limit"


def failure(status: Column, input_tokens: Column, output_tokens: Column, parsed: Column, answer: Column) -> Column:
    """Why a turn is no real result, or null: the agent failed; no tokens are counted and no draft was parsed, so the model never
    answered; or the draft is a provider's error. Nulls count as 0, as not parsed and as empty."""
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    silent = none(input_tokens) & none(output_tokens) & ~F.coalesce(parsed, F.lit(False))
    return F.when(status == "error", "agent error").when(silent, "model never answered").when(F.coalesce(answer, F.lit("")).rlike(PROVIDER_ERROR), "provider error in draft")


def answer_sentences(c: Column) -> Column:
    """Sentences and list items of an answer as an array; stops of legal abbreviations end none."""
    hidden = F.regexp_replace(c, PROTECTED, "$1․")
    parts = F.split(hidden, r"(?<=[.!?])\s+(?=[A-Z\"“(\[])|\n+\s*(?:[-*•]|\d+\.)?\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("․"), F.lit(".")))), lambda s: s != "")


def is_advice(c: Column) -> Column:
    """Whether a question asks for advice."""
    return F.coalesce(c.rlike(ADVICE), F.lit(False))


def is_heading(s: Column) -> Column:
    """A short line in capitals that asserts nothing."""
    return (F.upper(s) == s) & (F.lower(s) != s) & (F.size(F.split(F.trim(s), r"\s+")) <= 6) & ~s.rlike(r"\.\s*$") & ~s.rlike(HEADING_VERBS)


def status_claims(c: Column) -> Column:
    """How many sentences assert that law is current without saying that it isn't verified."""
    return F.size(F.filter(answer_sentences(F.coalesce(c, F.lit(""))), lambda s: s.rlike(STATUS_CLAIM) & ~s.rlike(STATUS_QUALIFIER)))


def markers(c: Column) -> Column:
    """The citation numbers that an answer's markers give, ascending."""
    inner = F.regexp_extract_all(c, F.lit(MARKER), 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(inner, lambda m: F.transform(F.split(m, ","), lambda x: F.trim(x).cast("int"))))))


def name_mismatch(cited: Column, resolved: Column) -> Column:
    """Whether the name before a citation shares no word of four letters with the name that it was resolved to."""
    head = F.when(cited.rlike(CASE_CITE), F.lower(F.split(cited, CASE_CITE)[0])).otherwise("")
    words = F.filter(F.regexp_extract_all(head, F.lit(r"([a-z][a-z'-]{3,})"), 1), lambda w: ~w.isin(*NAME_STOP))
    return (F.size(words) > 0) & (F.coalesce(resolved, F.lit("")) != "") & ~F.exists(words, lambda w: F.contains(F.lower(resolved), w))


def verified_citations(drafts: DataFrame, known: DataFrame, pages: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """draft_id, marker, case, case_id, in_corpus, tier, matched_page, reason of each citation of the drafts.

    drafts: draft_id, answer, citations array<struct<case, quote, page>>. external: citation, status, case_name, reason, the results
    of lookups outside the corpus; a missing one is unresolved, and without the table resolution is disabled.
    """
    rows = drafts.select("draft_id", F.posexplode("citations").alias("pos", "c")).select("draft_id", (F.col("pos") + 1).alias("marker"), F.coalesce("c.case", F.lit("")).alias("case"), "c.quote", F.col("c.page").cast("int").alias("page"))
    found = resolve(rows, known, "case").withColumnRenamed("ref", "case")
    rows = checkpointed(rows.join(found, "case", "left"))  # citations of the drafts, read twice
    inside = checked_quotes(rows.filter(F.col("case_id").isNotNull()), pages)
    tier = F.when(F.col("quote_match"), VERIFIED).otherwise(UNVERIFIED)
    reason = F.when(F.coalesce("quote", F.lit("")) == "", "in-corpus citation needs a supporting quote + page").when(~F.col("quote_match"), "quote not found in stored page text")
    first = inside.select("draft_id", "marker", "case", "case_id", F.lit(True).alias("in_corpus"), tier.alias("tier"), "matched_page", reason.alias("reason"))
    out = rows.filter(F.col("case_id").isNull()).withColumn("k", canon(F.col("case"))["kind"])
    if external is None:
        out = out.withColumn("status", F.lit("disabled")).withColumn("case_name", F.lit(None).cast("string")).withColumn("why", F.lit("external resolution disabled"))
    else:
        out = out.join(external.select(F.col("citation").alias("case"), "status", "case_name", F.col("reason").alias("why")), "case", "left")
    reporter, solved, bad = F.col("k") == "case", F.coalesce(F.col("status") == "resolved", F.lit(False)), name_mismatch(F.col("case"), F.col("case_name"))
    quoted = F.coalesce("quote", F.lit("")) != ""
    tier = F.when(reporter & solved & ~bad & ~quoted, EXTERNAL).otherwise(UNVERIFIED)
    reason = F.when(~reporter, "not in the corpus and not a reporter citation").when(solved & bad, "cited name does not match the resolved case").when(solved & quoted, "quote cannot be checked: the external text is not stored").when(~solved, F.coalesce("why", F.lit("the citation was not resolved")))
    second = out.select("draft_id", "marker", "case", "case_id", F.lit(False).alias("in_corpus"), tier.alias("tier"), F.lit(None).cast("int").alias("matched_page"), reason.alias("reason"))
    return first.unionByName(second)


def _attributed(answer: str) -> list[tuple[str, list[int], bool]]:
    """(quote, numbers of its own marker, whether it is a full quotation) of an answer's quoted spans: the first marker behind a
    span on its line, else the last before it."""
    out = []
    for m in _QUOTED.finditer(answer):
        quote = next(g for g in m.groups() if g)
        n = len(quote.split())
        if n < QUOTE_LEAST or _CASE_CITE.fullmatch(quote.strip(" ,.;")):
            continue
        low = answer.rfind("\n", 0, m.start()) + 1
        high = answer.find("\n", m.end())
        after = _MARKER.search(answer, m.end(), high if high >= 0 else len(answer))
        before = [x for x in _MARKER.finditer(answer, low, m.start())]
        own = after or (before[-1] if before else None)
        out.append((quote, [int(x) for x in own[1].split(",")] if own else [], n >= QUOTATION_LEAST))
    return out


def answer_quotes(drafts: DataFrame) -> DataFrame:
    """draft_id, quote_no, quote, markers, full of the quoted spans in the drafts' answers, without terms of one or two words, bare
    citations and the status label."""

    @F.pandas_udf("array<struct<quote: string, markers: array<int>, full: boolean>>")
    def spans(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: _attributed(a or ""))

    rows = drafts.select("draft_id", F.posexplode(spans("answer")).alias("quote_no", "q")).select("draft_id", "quote_no", "q.*")
    label = F.lower(match_key(F.lit(STATUS_LABEL)))
    return rows.filter(F.lower(F.regexp_replace(match_key(F.col("quote")), r"^[.,;:]+|[.,;:]+$", "")) != label)


def answer_problems(drafts: DataFrame, citations: DataFrame, pages: DataFrame) -> DataFrame:
    """draft_id, kind, detail: what keeps a draft from passing. citations are those of verified_citations."""
    citations = checkpointed(citations)
    used = drafts.select("draft_id", F.explode(markers(F.col("answer"))).alias("marker"))
    given = citations.select("draft_id", "marker")
    text = lambda c: F.col(c).cast("string").alias("detail")
    dangling = used.join(given, ["draft_id", "marker"], "left_anti").select("draft_id", F.lit("dangling_marker").alias("kind"), text("marker"))
    unused = given.join(used, ["draft_id", "marker"], "left_anti").select("draft_id", F.lit("unused_citation").alias("kind"), text("marker"))
    bad = citations.filter(F.col("tier") == UNVERIFIED).select("draft_id", F.lit("unverified_citation").alias("kind"), text("marker"))
    none = drafts.filter(F.coalesce(F.size("citations"), F.lit(0)) < 1).select("draft_id", F.lit("no_citations").alias("kind"), F.lit("").alias("detail"))
    s = drafts.select("draft_id", F.explode(answer_sentences(F.coalesce("answer", F.lit("")))).alias("s")).filter(~F.col("s").rlike(EXEMPT) & ~is_heading(F.col("s")))
    marked = F.col("s").rlike(MARKER)
    claim = s.filter(F.col("s").rlike(LEGAL_CUES) & ~marked).select("draft_id", F.lit("uncited_claim").alias("kind"), F.substring("s", 1, 300).alias("detail"))
    cite = s.filter(~marked).select("draft_id", F.lit("uncited_case_reference").alias("kind"), F.explode(F.regexp_extract_all("s", F.lit(f"({CASE_CITE})"), 1)).alias("detail"))
    status = s.filter(F.col("s").rlike(STATUS_CLAIM) & ~F.col("s").rlike(STATUS_QUALIFIER)).select("draft_id", F.lit("unqualified_status_claim").alias("kind"), F.substring("s", 1, 300).alias("detail"))
    quotes = answer_quotes(drafts)
    where = citations.filter(F.col("in_corpus")).select("draft_id", "marker", "case_id")
    tries = quotes.join(where, "draft_id", "left").filter(F.col("case_id").isNotNull() & (~F.col("full") | F.array_contains("markers", F.col("marker"))))
    literal = checkpointed(checked_quotes(tries.select("draft_id", "quote_no", "quote", "case_id", F.lit(None).cast("int").alias("page")).distinct(), pages))
    held = literal.filter("quote_match").select("draft_id", "quote_no").unionByName(altered_quotes(literal.filter(~F.col("quote_match")), pages, ["draft_id", "quote_no"])).distinct()
    quote = quotes.join(held, ["draft_id", "quote_no"], "left_anti").select("draft_id", F.lit("unverified_quote").alias("kind"), F.substring("quote", 1, 200).alias("detail"))
    out = dangling
    for part in (unused, bad, none, claim, cite, status, quote):
        out = out.unionByName(part)
    return out


def answer_reports(drafts: DataFrame, citations: DataFrame, problems: DataFrame) -> DataFrame:
    """draft_id, passed, problem_kinds (distinct, sorted) and the number of citations in each tier."""
    kinds = problems.groupBy("draft_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("problem_kinds"))
    tiers = citations.groupBy("draft_id").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in (VERIFIED, EXTERNAL, UNVERIFIED)])
    out = drafts.select("draft_id").join(kinds, "draft_id", "left").join(tiers, "draft_id", "left").fillna(0, [VERIFIED, EXTERNAL, UNVERIFIED])
    return out.select("draft_id", F.col("problem_kinds").isNull().alias("passed"), F.coalesce("problem_kinds", F.lit("")).alias("problem_kinds"), VERIFIED, EXTERNAL, UNVERIFIED)


def salvaged(drafts: DataFrame, citations: DataFrame, problems: DataFrame) -> DataFrame:
    """draft_id, answer, cases of drafts of which something holds: sentences whose markers are all backed and that no problem
    names, markers numbered anew in order of use, and the citations in that order."""
    backed = citations.filter(F.col("tier") != UNVERIFIED).groupBy("draft_id").agg(F.collect_set("marker").alias("ok"))
    whole = problems.filter(F.col("kind").isin("uncited_claim", "unqualified_status_claim")).groupBy("draft_id").agg(F.collect_set("detail").alias("flagged"))
    bits = problems.filter(F.col("kind").isin("unverified_quote", "uncited_case_reference")).groupBy("draft_id").agg(F.collect_set(F.substring("detail", 1, 60)).alias("bits"))
    rows = drafts.select("draft_id", F.posexplode(answer_sentences(F.coalesce("answer", F.lit("")))).alias("pos", "s")).join(backed, "draft_id").join(whole, "draft_id", "left").join(bits, "draft_id", "left")
    nums = markers(F.col("s"))
    empty = F.array().cast("array<string>")
    keep = (F.size(nums) > 0) & (F.size(F.array_except(nums, F.col("ok"))) == 0) & ~F.array_contains(F.coalesce("flagged", empty), F.substring("s", 1, 300)) & ~F.exists(F.coalesce("bits", empty), lambda b: F.contains("s", b))
    kept = rows.filter(keep).groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sentences"))

    @F.pandas_udf("answer string, used array<int>")
    def renumber(lists: pd.Series) -> pd.DataFrame:
        out = []
        for sentences in lists:
            used: list[int] = []
            for s in sentences:
                used += [n for m in _MARKER.finditer(s) for n in map(int, m[1].split(",")) if n not in used]
            used = list(dict.fromkeys(used))
            new = {old: i for i, old in enumerate(used, 1)}
            out.append((" ".join(_MARKER.sub(lambda m: "[" + ", ".join(str(new[int(n)]) for n in m[1].split(",")) + "]", s) for s in sentences), used))
        return pd.DataFrame(out, columns=["answer", "used"])

    made = kept.withColumn("r", renumber("sentences")).select("draft_id", "r.*").join(drafts.select("draft_id", "citations"), "draft_id")
    return made.select("draft_id", "answer", F.array_join(F.transform("used", lambda n: F.element_at("citations", n)["case"]), "; ").alias("cases"))


def cited_cases(drafts: DataFrame, citations: DataFrame) -> DataFrame:
    """draft_id, cited: the cases of verified citations that the answer refers to by a marker, each once, in order of citation."""
    used = drafts.select("draft_id", F.explode(markers(F.col("answer"))).alias("marker"))
    hits = citations.filter((F.col("tier") == VERIFIED) & F.col("case_id").isNotNull()).join(used, ["draft_id", "marker"])
    first = hits.groupBy("draft_id", "case_id").agg(F.min("marker").alias("marker"))
    return first.groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("marker", "case_id"))), lambda x: x["case_id"]).alias("cited"))
