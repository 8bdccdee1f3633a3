from __future__ import annotations

import json

import pytest

from docketry.operators import answers, extraction

PAGES = [("c", 1, "The harbor rule was first stated by Justice O'Brien in this case."), ("c", 2, "We follow the earlier case on the harbor rule in every part."), ("c", 3, "The panel dismissed the appeal for want of a pass.")]
UNITS = [("c__u1of2", "c", None), ("c__u2of2", "c", 2)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "case_id string, page int, text string")


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "unit_id string, case_id string, repeated_page int")


def item(kind, label, *quotes, **k):
    return {"type": kind, "label": label, "evidence": [{"page": p, "quote": q} for p, q in quotes], **k}


@pytest.fixture(scope="module")
def replies(spark):
    one = [item("rule", "Harbor rule", (1, "The harbor rule was first stated"), confidence=0.9), item("fact", "made up", (1, "words that are nowhere to be found"), confidence=0.9), item("odd", "x", (1, "q")), item("rule", "", (1, "q")), item("fact", "none")]
    two = [item("rule", "harbor  RULE", (2, "We follow the earlier case on the"), confidence="0.95"), item("fact", "again", (2, "the harbor rule in every part")), item("outcome", "dismissed", ("3", "dismissed the appeal for want"), (3, "nothing of the kind is here"), attrs={"k": "v"})]
    edges = [{"source": "c:rule:harbor_rule", "target": "c:outcome:dismissed", "relation": "supports", "evidence": [{"page": 3, "quote": "The panel dismissed the appeal"}]}] * 2 + [{"source": "c:rule:harbor_rule", "target": "ghost", "relation": "supports", "evidence": []}, {"source": "c:outcome:dismissed", "target": "c:rule:harbor_rule", "relation": "supports", "evidence": []}]
    rows = [("c__u1of2", "nodes", "Sure!\n```json\n" + json.dumps({"nodes": one}) + "\n```", "stop"), ("c__u2of2", "nodes", json.dumps({"nodes": two}), "stop"), ("c__u2of2", "nodes", '{"nodes": [', "length"), ("c__u2of2", "edges", "so " + json.dumps({"edges": edges}) + " done", "stop"), ("c__u1of2", "edges", "no json", None)]
    return spark.createDataFrame(rows, "unit_id string, stage string, text string, finish_reason string")


def test_nodes(spark, replies, units, pages):
    assert sorted(r[0] for r in extraction.node_items(replies, units).filter("reason IS NOT NULL").select("reason").collect()) == ["missing evidence", "missing label", "unknown node type: odd"]
    got = {r["id"]: r for r in extraction.extracted_nodes(replies, units, pages).collect()}
    assert set(got) == {"c:rule:harbor_rule", "c:fact:made_up", "c:outcome:dismissed"}  # what stands only on the repeated page is left out
    assert got["c:rule:harbor_rule"]["provenance"] == "llm" and got["c:fact:made_up"]["provenance"] == "unverified" and got["c:fact:made_up"]["confidence"] == 0.3
    assert got["c:outcome:dismissed"]["confidence"] == 0.56 and [e["page"] for e in got["c:outcome:dismissed"]["evidence"]] == [3]


def test_edges(spark, replies, units, pages, rows):
    nodes = extraction.extracted_nodes(replies, units, pages).cache()
    allowed = spark.createDataFrame([("rule", "supports", "outcome")], "source_type string, relation string, target_type string")
    edges, bad = extraction.extracted_edges(replies, units, nodes, pages, allowed)
    one = edges.collect()
    assert len(one) == 1 and one[0]["provenance"] == "llm" and one[0]["basis"] == "explicit"
    assert [r[2] for r in rows(bad)] == ["unknown node id: ghost", "disallowed signature: outcome -supports-> rule"]


def test_treatments_and_case_data(spark, pages, rows):
    t = spark.createDataFrame([("c", "d", json.dumps({"treatment": " Follows", "quote": "We follow the earlier case on", "page": 1, "confidence": 2})), ("c", "e", json.dumps({"treatment": "cites", "quote": "x"})), ("c", "f", json.dumps({"treatment": "overrules", "quote": "no such words in it"})), ("c", "g", "no json")], "source string, target string, text string")
    edges, lost = extraction.accepted_treatments(t, pages)
    assert [(r["type"], r["target"], r["page"], r["confidence"]) for r in edges.collect()] in ([("FOLLOWS", "d", 2, 1.0)], [("FOLLOWS", "d", 1, 1.0)])
    assert dict(rows(lost)) == {"treatment_cites": 2, "treatment_unverified_quote": 1}
    known = spark.createDataFrame([("c", "High Court")], "id string, court string")
    m = spark.createDataFrame([("c", json.dumps({"doctrines": [{"name": "Harbor  Rule", "quote": "The harbor rule was first stated", "page": 1}, {"name": "x", "quote": "not there at all", "page": 1}, {"name": " "}], "author": {"name": "Justice O'BRIEN", "quote": "first stated by Justice O'Brien in", "page": 1}})), ("c", json.dumps({"author": {"name": "Roe", "quote": "first stated by Justice O'Brien in"}}))], "case_id string, text string")
    edges, lost = extraction.accepted_case_data(m, pages, known)
    assert {(r["type"], r["target"]) for r in edges.collect()} == {("INVOKES_DOCTRINE", "doctrine:harbor_rule"), ("AUTHORED_BY", "judge:high_court:o_brien")}
    assert dict(rows(lost)) == {"doctrine_unverified_quote": 1, "author_unverified": 1}


def test_cited_cases_need_a_marker(spark, rows):
    d = spark.createDataFrame([("x", "As in [2] and [1, 3]."), ("y", "none")], "draft_id string, answer string")
    c = spark.createDataFrame([("x", 1, "b", answers.VERIFIED), ("x", 2, "a", answers.VERIFIED), ("x", 3, "a", answers.VERIFIED), ("x", 4, "z", answers.VERIFIED), ("x", 3, "q", answers.UNVERIFIED)], "draft_id string, marker int, case_id string, tier string")
    assert rows(answers.cited_cases(d, c)) == [("x", ["b", "a"])]


def test_mapped_tier(spark):
    from docketry.operators.graph import mapped_tier

    ev = "evidence array<struct<page: int, quote: string>>"
    node = f"unit_id string, case_id string, id string, type string, label string, author string, part string, provenance string, confidence double, cite_string string, kind string, doctrine string, {ev}"
    q = lambda *p: [(i, f"q{i}") for i in p]
    nodes = spark.createDataFrame(
        [
            ("u1", "c", "o", "opinion", "op", "Justice ROE", "majority", "llm", 0.9, None, None, None, q(1)), ("u1", "c", "o2", "opinion", "op", "ROE", "dissent", "llm", 0.95, None, None, None, q(2)),
            ("u1", "c", "r", "rule", "The  Harbor rule", None, None, None, 0.5, None, None, None, q(1)), ("u1", "c", "r2", "rule", "x", None, None, "unverified", 0.2, None, None, "Lost", q(1)),
            ("u1", "c", "a1", "authority_ref", "a", None, None, "llm", 1.0, "585 U. S. 198", "case", None, q(1)), ("u1", "c", "a2", "authority_ref", "a", None, None, "llm", 1.0, "9 F.3d 9", "case", None, q(1)), ("u1", "c", "a3", "authority_ref", "a", None, None, "llm", 1.0, "1 I&N Dec. 1", "case", None, q(1)), ("u1", "c", "a4", "authority_ref", "s", None, None, "llm", 1.0, "8 U.S.C. § 1", "statute", None, q(1)),
        ],
        node,
    )
    edges = spark.createDataFrame([("u1", "c", "r", "a1", "relies_on", "follows", "llm", 0.8, q(1, 2, 3, 4)), ("u1", "c", "r", "a2", "relies_on", "criticizes", "llm", 0.7, q(1)), ("u1", "c", "r", "a3", "relies_on", "follows", "llm", 0.7, q(1)), ("u1", "c", "r", "a4", "relies_on", "follows", "llm", 0.7, q(1)), ("u1", "c", "r", "a1", "supports", None, "llm", 0.7, q(1)), ("u1", "c", "r", "a2", "relies_on", None, "unverified", 0.3, q(9))], f"unit_id string, case_id string, source string, target string, relation string, stance string, provenance string, confidence double, {ev}")
    known = spark.createDataFrame([("c", "immigration", "High Court", "in_dec:1_1"), ("d", "litigation", None, "us:585_198")], "id string, domain string, court string, canon_id string")
    got = {(r["type"], r["target"]): r for r in mapped_tier(nodes, edges, known).collect()}
    assert set(got) == {("AUTHORED_BY", "judge:high_court:roe"), ("INVOKES_DOCTRINE", "doctrine:the_harbor_rule"), ("FOLLOWS", "d"), ("CITES_LLM", "auth:f3d:9_9")}
    assert got["AUTHORED_BY", "judge:high_court:roe"]["notes"] == ["majority", "dissent"] and got["AUTHORED_BY", "judge:high_court:roe"]["confidence"] == 0.95
    assert len(got["FOLLOWS", "d"]["evidence"]) == 3 and got["CITES_LLM", "auth:f3d:9_9"]["notes"] == ["criticizes"]
    assert ("INVOKES_DOCTRINE", "doctrine:lost") in {(r["type"], r["target"]) for r in mapped_tier(nodes, edges, known, unverified=True).collect()}
