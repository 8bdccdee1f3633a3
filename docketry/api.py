"""The questions that a research tool asks of a corpus, as methods that return DataFrames.

Limits are clamped to each question's range. Texts of cases are returned as they are unless `fence` is set, which puts every
free-text field between markers of untrusted text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import fence_fields
from docketry.operators import analytics, answers, graph, ledger, search
from docketry.sources.records import read_only_sql
from docketry.sources.tables import checkpointed


def clamp(n: int, low: int, high: int) -> int:
    """n within [low, high]."""
    return max(low, min(int(n), high))


class Corpus:
    """A corpus: known cases (of graph.cases), pages (case_id, page, text) and a graph (nodes, edges)."""

    def __init__(self, spark: SparkSession, known: DataFrame, pages: DataFrame, nodes: DataFrame, edges: DataFrame, *, external: DataFrame | None = None, fence: bool = False) -> None:
        self.spark, self.known, self.pages, self.nodes, self.edges, self.external, self.fence = spark, known, pages, nodes, edges, external, fence

    def _out(self, df: DataFrame, source: str) -> DataFrame:
        return fence_fields(df, source) if self.fence else df

    def case_id(self, ref: str) -> str:
        """The id of the case that a reference means; an error if there is none."""
        row = search.resolve(self.spark.range(1).select(F.lit(ref).alias("ref")), self.known).first()
        if row is None or row["case_id"] is None:
            raise LookupError(f"no such case: {ref}")
        return row["case_id"]

    def search_cases(self, query: str, domain: str | None = None, limit: int = 8) -> DataFrame:
        return self._out(search.search_cases(self.known, self.pages, query, domain, clamp(limit, 1, 25)), "search_cases")

    def search_case_text(self, query: str, case_id: str | None = None, limit: int = 6) -> DataFrame:
        only = self.case_id(case_id) if case_id else None
        return self._out(search.search_pages(self.pages, self.known, query, only, clamp(limit, 1, 20)), "search_case_text")

    def get_case(self, ref: str) -> DataFrame:
        case = self.case_id(ref)
        one = self.known.filter(F.col("id") == case)
        return search.case_summaries(one, self.pages.filter(F.col("case_id") == case), self.edges.filter((F.col("source") == case) | (F.col("target") == case)), graph.CITATION_EDGES)

    def read_page(self, ref: str, page: int) -> DataFrame:
        case = self.case_id(ref)
        own = self.pages.filter(F.col("case_id") == case)
        out = own.filter(F.col("page") == page)
        if out.isEmpty():
            there = sorted(r[0] for r in own.select("page").collect())
            raise LookupError(f"{case} has no page {page}; its pages are {there}")
        return self._out(out.withColumnRenamed("text", "quote"), "read_page").withColumnRenamed("quote", "text")

    def find_citing_cases(self, ref: str) -> DataFrame:
        return self._out(analytics.find_citing(self.nodes, self.edges, self.case_id(ref)), "find_citing_cases")

    def find_cited_cases(self, ref: str, in_corpus_only: bool = False, limit: int = 80) -> DataFrame:
        """Up to `limit` rows in order of their ids, with `truncated`: whether there are more."""
        rows = analytics.find_cited(self.nodes, self.edges, self.case_id(ref), in_corpus_only)
        n = rows.select(F.count(F.lit(1))).scalar()
        return self._out(rows.orderBy("cited_id", "type").limit(limit).withColumn("truncated", n > limit), "find_cited_cases")

    def precedent_chain(self, ref: str, max_depth: int = 3, to_domain: str | None = "litigation") -> DataFrame:
        return analytics.precedent_chain(self.nodes, self.edges, self.case_id(ref), clamp(max_depth, 1, 5), to_domain)

    def graph_stats(self) -> DataFrame:
        return graph.graph_stats(self.nodes, self.edges)

    def run_sql(self, query: str) -> DataFrame:
        """The first 50 rows of a reading query over nodes, edges, pages and cases."""
        return read_only_sql(self.spark, nodes=self.nodes, edges=self.edges, pages=self.pages, cases=self.known)(query, 50)

    def verify_citation(self, case: str, quote: str | None = None, page: int | None = None) -> DataFrame:
        return answers.verified_citations(self._draft("", [(case, quote, page)]), self.known, self.pages, self.external)

    def verify_answer(self, answer: str, citations: list[tuple[str, str | None, int | None]]) -> DataFrame:
        drafts = self._draft(answer, citations)
        found = checkpointed(answers.verified_citations(drafts, self.known, self.pages, self.external))
        return answers.answer_reports(drafts, found, answers.answer_problems(drafts, found, self.pages))

    def _draft(self, answer: str, citations: list[tuple[str, str | None, int | None]]) -> DataFrame:
        return self.spark.createDataFrame([("draft", answer, citations)], "draft_id string, answer string, citations array<struct<case: string, quote: string, page: int>>")

    def most_cited_precedents(self, k: int = 10, scope: str = "all", method: str = "pagerank") -> DataFrame:
        return analytics.most_cited(self.nodes, self.edges, clamp(k, 1, 50), scope, method)

    def statute_frequency(self, k: int = 10, domain: str | None = None) -> DataFrame:
        return analytics.statute_frequency(self.nodes, self.edges, clamp(k, 1, 50), domain)

    def doctrine_influence(self, k: int = 10) -> DataFrame:
        return analytics.doctrine_influence(self.nodes, self.edges, clamp(k, 1, 50))

    def cross_corpus_bridges(self, k: int = 20) -> DataFrame:
        return analytics.cross_corpus_bridges(self.nodes, self.edges, clamp(k, 1, 60))

    def resolve_citation(self, citation: str) -> DataFrame:
        """What the table of external lookups has of a citation."""
        if self.external is None:
            raise LookupError("external resolution is disabled")
        return self.external.filter(F.col("citation") == citation)

    @staticmethod
    def quota_status(events: DataFrame, key: str, time: str, limits: dict[str, int]) -> DataFrame:
        return ledger.quota_used(events, key, time, limits)
