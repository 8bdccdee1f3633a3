from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docketry.api import Corpus
from docketry.operators import analytics, graph, search
from docketry.sources.records import export_json, import_graph_json, read_graph, write_graph

T0 = datetime(2031, 1, 1)
RECORD = "id string, domain string, title string, citation string, decision_date string, decision_year int, issuing_body string, court string, docket_number string, term int, source_url string, page_count int, citations array<string>, loaded_at timestamp"


def record(i, domain, title, citation, citations):
    return (i, domain, title, citation, None, None, None, "Court", None, None, None, None, citations, T0)


@pytest.fixture(scope="module")
def corpus(spark):
    records = spark.createDataFrame(
        [
            record("imm1", "immigration", "Matter of Alpha", "25 I&N Dec. 100", ["585 U.S. 198", "585 U.\nS. 198", "9 F.3d 9", "25 I&N Dec. 100", "8 U.S.C. § 1182"]),
            record("imm2", "immigration", "Matter of Beta", None, ["25 I&N Dec. 100"]),
            record("lit1", "litigation", "Gamma v. Delta", "585 U.S. 198", None),
            record("lit1", "litigation", "Gamma v. Delta", "585 U.S. 198", None),
        ],
        RECORD,
    )
    lead = spark.createDataFrame([], RECORD)
    pages = {"imm1": {1: "As Gamma  v.\nDelta, 585 U.\nS. 198, held, the harbor rule holds. See 1585 U.S. 1980.", 2: "The harbor pass “never” lapsed, the panel found."}, "imm2": {1: "On harbor passes see 25 I&N Dec. 100."}, "lit1": {1: "OPINION. The harbor is open."}}
    units = spark.createDataFrame([(c, p) for c, p in pages.items()] * 2, "case_id string, raw_pages map<int, string>")
    mentions = spark.createDataFrame([("n1", "imm1", "usc:8_1182", "statute", "8 U.S.C. § 1182", 1, "q1"), ("n1", "imm1", "usc:8_1182", "statute", "8 U.S.C. § 1182", 1, "q1"), ("n2", "imm1", "usc:8_1182", "statute", "8 U.S.C. § 1182", 2, "q2"), ("n3", "imm1", None, "statute", None, 2, None), ("n4", "imm2", "other:x", "other", "x", 1, "q")], "mention_id string, case_id string, canon_id string, kind string, display string, page int, quote string")
    matches = spark.createDataFrame([("m1", "imm1", "lit1", "name", 1, "Gamma v. Delta"), ("m2", "imm1", "lit1", "reporter", 1, "585 U.S. 198"), ("m3", "imm2", "lit1", "name", None, None), ("m4", "imm2", "gone", "name", 1, "x"), ("m5", None, "lit1", "name", 1, "x")], "match_id string, source string, target string, basis string, page int, quote string")
    nodes, edges = graph.build_graph(records, lead, units, mentions, matches)
    return {"records": records, "lead": lead, "units": units, "known": graph.cases(records, lead), "pages": graph.case_pages(units), "nodes": nodes.cache(), "edges": edges.cache()}


def edge(corpus, kind, source, target):
    return corpus["edges"].filter((F.col("type") == kind) & (F.col("source") == source) & (F.col("target") == target)).first()


def test_one_edge_for_a_citation_broken_over_lines(corpus):
    e = edge(corpus, "CITES", "imm1", "lit1")
    assert e["bases"] == ["detected_citation", "name", "reporter"] and e["confidence"] == 1.0 and e["scope"] == "cross_domain" and len(e["evidence"]) == 3
    assert "585 U.\nS. 198" in e["evidence"][0]["quote"] and e["provenance"] == "deterministic"


def test_citation_without_text_is_an_unverified_authority(corpus):
    e = edge(corpus, "CITES", "imm1", "auth:f3d:9_9")
    assert (e["provenance"], e["confidence"], e["evidence"], e["scope"]) == ("unverified", 0.5, [], "external")
    n = corpus["nodes"].filter("id = 'auth:f3d:9_9'").first()
    assert (n["label"], n["provenance"], n["confidence"]) == ("Authority", "unverified", 0.5)


def test_self_citations_and_statutes_give_no_citation_edges(corpus):
    assert {r[0] for r in corpus["edges"].filter("type = 'CITES' AND source = 'imm1'").select("target").collect()} == {"lit1", "auth:f3d:9_9"}
    e = edge(corpus, "MENTIONS_STATUTE", "imm1", "usc:8_1182")
    assert e["count"] == 2 and [x["page"] for x in e["evidence"]] == [1, 2]


def test_match_without_evidence_and_dangling_ends(corpus):
    e = edge(corpus, "CITES", "imm2", "lit1")
    assert (e["provenance"], e["confidence"]) == ("unverified", 0.5)
    assert corpus["edges"].filter("target = 'gone' OR source IS NULL").count() == 0


def test_pages_and_uncited_cases(corpus):
    assert corpus["edges"].filter("type = 'HAS_PAGE'").count() == 4
    assert {r["id"]: r["canon_id"] for r in corpus["known"].collect()}["imm2"] == "nocite:imm2"


def test_text_matches_find_names_over_blanks_and_bounded_numbers(corpus):
    got = {(r["source"], r["target"], r["basis"]) for r in graph.cross_domain_matches(corpus["known"], corpus["pages"], "immigration", "litigation").collect()}
    assert got == {("imm1", "lit1", "name"), ("imm1", "lit1", "reporter")}


def test_evidence_is_where_the_citation_itself_is(spark, rows):
    pages = spark.createDataFrame([("a", 1, "See 115 U.S. 20 (first), and then at length, and in other words, as has been said before, 15 U.S. 20 (the second)."), ("a", 2, "15 U.S. 20"), ("b", 1, "2115 U.S. 20")], "case_id string, page int, text string")
    cites = spark.createDataFrame([("a", "15 U.S. 20", 1), ("a", "15 U.S. 20", 2), ("b", "15 U.S. 20", 3), ("c", "1 U.S. 1", 4), ("a", None, 5)], "case_id string, raw string, n int")
    got = {r["n"]: (r["page"], r["quote"]) for r in graph.find_evidence(cites, pages).collect()}
    assert got[1] == got[2] and got[1][0] == 1 and got[1][1].endswith("said before, 15 U.S. 20 (the second).") and "115" not in got[1][1]
    assert got[3] == got[4] == got[5] == (None, None)


def test_matches_over_a_page_end_have_no_evidence(spark):
    known = spark.createDataFrame([("s", "immigration", "Matter of S", "nocite:s"), ("t", "litigation", "Gamma v. Delta", "us:585_198"), ("u", "litigation", "Delta", "nocite:u"), ("v", "litigation", "??", "nocite:v")], "id string, domain string, title string, canon_id string")
    pages = spark.createDataFrame([("s", 1, "as in Gamma v."), ("s", 2, "  "), ("s", 3, "Delta, 585 U.S."), ("s", 4, "198, and 1585 U.S. 198.")], "case_id string, page int, text string")
    got = {(r["target"], r["basis"]): (r["page"], r["quote"]) for r in graph.cross_domain_matches(known, pages, "immigration", "litigation").collect()}
    assert got == {("t", "name"): (None, None), ("t", "reporter"): (None, None), ("u", "name"): (3, "Delta, 585 U.S.")}
    more = pages.unionByName(spark.createDataFrame([("s", 5, "GAMMA  v. delta")], pages.schema))
    assert graph.cross_domain_matches(known, more, "immigration", "litigation").filter("target = 't' AND basis = 'name'").first()["page"] == 5
    assert graph.cross_domain_matches(known, pages.limit(0), "immigration", "litigation").count() == 0


def test_build_is_the_same_in_any_order(spark, corpus):
    again = graph.build_graph(corpus["records"].orderBy(F.desc("id")), corpus["lead"], corpus["units"].orderBy(F.desc("case_id")), *[spark.createDataFrame([], s) for s in ("mention_id string, case_id string, canon_id string, kind string, display string, page int, quote string", "match_id string, source string, target string, basis string, page int, quote string")])[1]
    key = lambda df: sorted(map(str, df.filter("type = 'HAS_PAGE'").collect()))
    assert key(again) == key(corpus["edges"])


def test_empty_tables_give_an_empty_graph(spark):
    empty = spark.createDataFrame([], RECORD)
    units = spark.createDataFrame([], "case_id string, raw_pages map<int, string>")
    mentions = spark.createDataFrame([], "mention_id string, case_id string, canon_id string, kind string, display string, page int, quote string")
    matches = spark.createDataFrame([], "match_id string, source string, target string, basis string, page int, quote string")
    nodes, edges = graph.build_graph(empty, empty, units, mentions, matches)
    assert nodes.count() == 0 and edges.count() == 0


def test_merge_keeps_the_first_tier_and_drops_dangling_edges(spark, rows):
    n = "id string, label string"
    e = "type string, source string, target string, v int"
    a = (spark.createDataFrame([("x", "A"), ("y", "A")], n), spark.createDataFrame([("T", "x", "y", 1)], e))
    b = (spark.createDataFrame([("x", "B"), ("z", "B")], n), spark.createDataFrame([("T", "x", "y", 2), ("U", "x", "y", 3), ("T", "x", "none", 4)], e))
    nodes, edges = graph.merge_tiers(a, b)
    assert rows(nodes) == [("x", "A"), ("y", "A"), ("z", "B")] and {r[3] for r in rows(edges)} == {1, 3}


def test_check_reports_missing_and_extra(spark, rows):
    edges = spark.createDataFrame([("CITES", "a", "b", ["name", "reporter"])], "type string, source string, target string, bases array<string>")
    expected = spark.createDataFrame([("a", "b", "name"), ("a", "c", "name"), ("unseen", "c", "name")], "source string, target string, basis string")
    assert rows(graph.check_edges(edges, expected)) == [("extra", "a", "b", "reporter"), ("missing", "a", "c", "name")]


def test_write_and_read(spark, corpus, tmp_path):
    write_graph(corpus["nodes"], corpus["edges"], str(tmp_path / "g"))
    nodes, edges = read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == corpus["nodes"].count() and edges.count() == corpus["edges"].count()
    export_json(edges, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == edges.count()
    with pytest.raises(ValueError):
        write_graph(corpus["nodes"].withColumn("label", F.lit("Odd")), corpus["edges"], str(tmp_path / "h"))


def test_import_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "Case", "props": {"title": "T", "n": 1}}], "edges": [{"type": "CITES", "source": "a", "target": "b", "props": {"count": 2, "bases": ["x"]}, "evidence": [{"page": 1, "quote": "q"}]}]}')
    nodes, edges = import_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.first()["title"] == "T" and edges.first()["count"] == 2 and edges.first()["bases"] == ["x"]


def test_pagerank_sums_to_one_and_ranks_the_sink_first(spark):
    ids = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    links = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "d"), ("a", "b"), ("a", "b")], "source string, target string")
    got = {r["id"]: r["rank"] for r in analytics.pagerank(ids, links).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == "d"
    pr = dict.fromkeys("abcd", 0.25)
    out = {"a": "db", "b": "d", "c": "d", "d": ""}
    for _ in range(60):
        idle = sum(pr[v] for v in out if not out[v])
        new = {v: 0.15 / 4 + 0.85 * idle / 4 for v in out}
        for s, ts in out.items():
            for t in ts:
                new[t] += 0.85 * pr[s] / len(ts)
        pr = new
    assert all(abs(pr[k] - got[k]) < 1e-8 for k in pr)
    twice = {r["id"]: r["rank"] for r in analytics.pagerank(ids, links, distinct=False).collect()}
    assert twice["b"] > got["b"]
    assert analytics.pagerank(ids.limit(0), links).count() == 0


def test_precedent_chain_takes_the_first_shortest_path(spark, rows):
    nodes = spark.createDataFrame([(c, "Case", "litigation" if c in "de" else "immigration") for c in "abcdef"] + [("auth:x", "Authority", None)], "id string, label string, domain string")
    edges = spark.createDataFrame([("CITES", s, t) for s, t in ("ac", "ab", "bd", "cd", "de", "ea", "ef")] + [("CITES", "a", "auth:x"), ("HAS_PAGE", "a", "f")], "type string, source string, target string")
    got = rows(analytics.precedent_chain(nodes, edges, "a", 3))
    assert got == [("b", "immigration", 1, "a > b"), ("c", "immigration", 1, "a > c"), ("d", "litigation", 2, "a > b > d"), ("e", "litigation", 3, "a > b > d > e")]
    assert {r[0] for r in rows(analytics.precedent_chain(nodes, edges, "a", 5, "litigation"))} == {"d", "e"}


def test_bm25_against_brute_force(spark):
    import math
    import re

    docs = ["harbor pass harbor", "the pass", "", "removal of the harbor-pass", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, text string")
    got = {r["i"]: r["score"] for r in search.bm25(df, "harbor harbor pass", ["i"]).collect()}
    toks = [[w for w in re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)*", d or "") if w not in ("the", "of")] for d in docs]
    mean = sum(map(len, toks)) / 5
    want = {}
    for i, t in enumerate(toks):
        s = 0.0
        for w in ("harbor", "harbor", "pass"):
            f, n = t.count(w), sum(w in x for x in toks)
            if f:
                s += math.log(1 + (5 - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / mean))
        if s:
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_resolution_order(spark, corpus):
    refs = ["imm1", "585 U. S. 198", "999 U.S. 1", "matter of alpha", "Beta", "In re Gamma v. Delta.", "Gam", "nobody", "", None]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    got = {r["ref"]: r["case_id"] for r in search.resolve(df, corpus["known"]).collect()}
    assert got == {"imm1": "imm1", "585 U. S. 198": "lit1", "999 U.S. 1": None, "matter of alpha": "imm1", "Beta": "imm2", "In re Gamma v. Delta.": "lit1", "Gam": None, "nobody": None}


def test_dense_top_k(spark, rows):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(40, 5))
    v[3] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)] + [(99, None)], "vec_id bigint, embedding array<float>")
    got = rows(search.dense_top_k(df, df.filter("vec_id % 10 = 0"), 4, pass_bytes=80))
    w = v.astype(np.float32).astype(float)
    n = np.linalg.norm(w, axis=1)
    for q in (0, 10, 20, 30):
        s = w @ w[q] / np.where(n == 0, 1, n) / n[q]
        assert [x[2] for x in got if x[0] == q] == sorted(range(40), key=lambda i: (-round(s[i], 9), i))[:4]


def test_questions(spark, corpus):
    c = Corpus(spark, corpus["known"], corpus["pages"], corpus["nodes"], corpus["edges"])
    assert c.search_cases("harbor pass", limit=999).count() == 3
    assert c.search_cases("585 U.S. 198").first()["case_id"] == "lit1"
    assert c.search_case_text("harbor", "imm1").first()["case_id"] == "imm1"
    assert c.get_case("Matter of Alpha").first()["n_pages"] == 2
    assert c.read_page("imm1", 2).first()["text"].startswith("The harbor")
    with pytest.raises(LookupError, match=r"\[1, 2\]"):
        c.read_page("imm1", 7)
    with pytest.raises(LookupError):
        c.find_citing_cases("999 U.S. 1")
    assert {r["case_id"] for r in c.find_citing_cases("lit1").collect()} == {"imm1", "imm2"}
    assert c.find_cited_cases("imm1", limit=1).first()["truncated"]
    assert c.find_cited_cases("imm1", in_corpus_only=True).count() == 1
    assert c.precedent_chain("imm2", 99).first()["target"] == "lit1"
    assert c.most_cited_precedents().first()["id"] == "lit1" and c.statute_frequency().first()["mentions"] == 2
    assert c.cross_corpus_bridges().first()["citing"] == 2 and c.graph_stats().count() > 5 and c.doctrine_influence().count() == 0
    assert c.run_sql("SELECT count(*) AS create_n FROM nodes WHERE id <> 'set x'").first()[0] > 3
    for bad in ("DROP VIEW nodes", "CREATE TABLE x AS SELECT 1", "INSERT INTO nodes SELECT 1", "SET a=b"):
        with pytest.raises(PermissionError):
            c.run_sql(bad)
    assert c.verify_citation("imm1", "The harbor pass never lapsed", 1).first()["matched_page"] == 2
    assert c.verify_answer("The panel held that the pass lapsed.", []).first()["problem_kinds"] == "no_citations, uncited_claim"
    fenced = Corpus(spark, corpus["known"], corpus["pages"], corpus["nodes"], corpus["edges"], fence=True)
    assert fenced.read_page("imm1", 2).first()["text"].startswith("<<<UNTRUSTED")
