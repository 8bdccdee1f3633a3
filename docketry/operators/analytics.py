"""Traversal of the citation graph and rankings over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.graph import CITATION_EDGES
from docketry.sources.tables import checkpointed


def find_citing(nodes: DataFrame, edges: DataFrame, case_id: str) -> DataFrame:
    """The citation edges into a case, with what is known of their sources and two pieces of evidence."""
    rows = edges.filter(F.col("type").isin(*CITATION_EDGES) & (F.col("target") == case_id))
    about = nodes.select(F.col("id").alias("source"), "title", "display", "domain")
    return rows.join(about, "source", "left").select("type", F.col("source").alias("case_id"), "title", F.col("display").alias("citation"), "domain", "scope", "bases", "provenance", "confidence", F.slice("evidence", 1, 2).alias("evidence"))


def find_cited(nodes: DataFrame, edges: DataFrame, case_id: str, in_corpus_only: bool = False) -> DataFrame:
    """The citation edges out of a case, to cases and authorities, or to cases only."""
    rows = edges.filter(F.col("type").isin(*CITATION_EDGES) & (F.col("source") == case_id))
    about = nodes.select(F.col("id").alias("target"), "label", "title", "display", "domain")
    out = rows.join(about, "target", "left")
    if in_corpus_only:
        out = out.filter(F.col("label") == "Case")
    return out.select("type", F.col("target").alias("cited_id"), "label", "title", F.col("display").alias("citation"), "domain", "scope", "bases", "provenance", "confidence", F.slice("evidence", 1, 2).alias("evidence"))


def precedent_chain(nodes: DataFrame, edges: DataFrame, case_id: str, max_depth: int = 3, to_domain: str | None = None) -> DataFrame:
    """target, depth, path (ids from the case to the target) of one shortest chain of citations to each case within reach.

    Level by level: of the chains that reach a case on its first level, that whose last case came first in the level before
    wins, then by edge type; within a level cases come in the order of their predecessors, then of their ids. Each level is one
    join of the frontier with the edges and an anti-join with what was reached, written to the shared checkpoint folder.
    """
    spark = nodes.sparkSession
    case_nodes = nodes.filter(F.col("label") == "Case").select("id", "domain")
    links = checkpointed(edges.filter(F.col("type").isin(*CITATION_EDGES)).select("source", "target", "type").join(case_nodes.select(F.col("id").alias("target")), "target", "left_semi"))
    frontier = spark.createDataFrame([(case_id, "0", [case_id], 0)], "id string, place string, path array<string>, depth int")
    reached = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("id").alias("source"), "place", "path").join(links, "source").join(reached.select(F.col("id").alias("target")), "target", "left_anti")
        best = step.groupBy("target").agg(F.min_by(F.struct("place", "path"), F.struct("place", "type")).alias("b"))
        # A case's place: its predecessor's, then its id; text that sorts as the order in which a queue would give them.
        frontier = checkpointed(best.select(F.col("target").alias("id"), F.concat_ws("\u0001", "b.place", "target").alias("place"), F.concat("b.path", F.array("target")).alias("path"), F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    out = reached.filter(F.col("depth") > 0).join(case_nodes, "id")
    if to_domain is not None:
        out = out.filter(F.col("domain") == to_domain)
    return out.select(F.col("id").alias("target"), "domain", "depth", F.array_join("path", " > ").alias("path"))


def pagerank(ids: DataFrame, links: DataFrame, *, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-10, distinct: bool = True, cut_every: int = 5) -> DataFrame:
    """id, rank: PageRank by power iteration, the mass of nodes without links spread evenly.

    Parallel links count once if `distinct`, else each. It stops when ranks change by less than `tolerance` in sum. A round is
    one join of ranks with links, hash-partitioned by source, and one aggregation by target with map-side combine; two numbers
    come to the driver. Every few rounds the ranks are written to the shared checkpoint folder, which cuts the lineage.
    """
    ids = checkpointed(ids.select("id").distinct())
    links = links.select("source", "target").join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    links = checkpointed(links.distinct() if distinct else links)
    degree = links.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    links = checkpointed(links.join(degree, "source"))
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    ends = links.select(F.col("source").alias("id")).distinct()
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        idle = ranks.join(ends, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = links.join(ranks.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("flow"))
        base = (1 - damping) / n + damping * idle / n
        new = ranks.join(flow, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"), F.abs(F.lit(base) + damping * F.coalesce("flow", F.lit(0.0)) - F.col("rank")).alias("change"))
        last = i == rounds
        if i % cut_every == 0 or (tolerance > 0 and not last):
            new = checkpointed(new)
        ranks = new.select("id", "rank")
        if tolerance > 0 and not last and new.agg(F.sum("change")).first()[0] < tolerance:
            break
    return ranks


def most_cited(nodes: DataFrame, edges: DataFrame, k: int = 10, scope: str = "all", method: str = "pagerank", rounds: int = 100) -> DataFrame:
    """rank, id, kind, title, domain, cited_by, pagerank, citing_domains of the k most cited cases (and authorities, unless scope is
    in_corpus), by PageRank over distinct pairs or by in-degree; the other breaks ties, then the id."""
    keep = nodes.filter(F.col("label").isin(*(("Case",) if scope == "in_corpus" else ("Case", "Authority"))))
    pairs = checkpointed(edges.filter(F.col("type").isin(*CITATION_EDGES)).select("source", "target").distinct().join(keep.select(F.col("id").alias("source")), "source", "left_semi").join(keep.select(F.col("id").alias("target")), "target", "left_semi"))
    degree = pairs.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("cited_by"))
    domains = pairs.join(nodes.select(F.col("id").alias("source"), "domain"), "source").groupBy(F.col("target").alias("id"), "domain").agg(F.count(F.lit(1)).alias("n"))
    domains = domains.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("domain", "n"))), lambda x: F.concat_ws(":", x["domain"], x["n"].cast("string"))), " ").alias("citing_domains"))
    ranks = pagerank(keep, pairs, rounds=rounds).withColumnRenamed("rank", "pagerank")
    rows = degree.join(ranks, "id")
    first, second = ("pagerank", "cited_by") if method == "pagerank" else ("cited_by", "pagerank")
    order = [F.desc(F.round(F.col(first), 12)), F.desc(F.round(F.col(second), 12)), F.col("id")]
    top = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.join(domains, "id").join(nodes.select("id", "label", "title", "domain"), "id").select("rank", "id", F.col("label").alias("kind"), "title", "domain", "cited_by", F.round("pagerank", 6).alias("pagerank"), "citing_domains").orderBy("rank")


def statute_frequency(nodes: DataFrame, edges: DataFrame, k: int = 10, domain: str | None = None) -> DataFrame:
    """rank, id, display, kind, cases, mentions of the k statutes that most cases mention; then by mentions, then id."""
    rows = edges.filter(F.col("type") == "MENTIONS_STATUTE")
    if domain is not None:
        rows = rows.join(nodes.filter(F.col("domain") == domain).select(F.col("id").alias("source")), "source", "left_semi")
    order = [F.desc("cases"), F.desc("mentions"), F.col("id")]
    top = rows.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.coalesce("count", F.lit(1))).alias("mentions")).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).join(nodes.select("id", "display", "label"), "id").select("rank", "id", "display", F.col("label").alias("kind"), "cases", "mentions").orderBy("rank")


def doctrine_influence(nodes: DataFrame, edges: DataFrame, k: int = 10, rounds: int = 100) -> DataFrame:
    """rank, id, cases, influence, mean_confidence of the k doctrines that most cases invoke. Influence is the sum of the cases'
    PageRank over citations between cases, parallel ones counted each."""
    case_nodes = nodes.filter(F.col("label") == "Case")
    ranks = pagerank(case_nodes, edges.filter(F.col("type").isin(*CITATION_EDGES)), distinct=False, rounds=rounds).select(F.col("id").alias("source"), F.col("rank").alias("weight"))
    uses = edges.filter(F.col("type") == "INVOKES_DOCTRINE")
    rows = uses.join(ranks, "source", "left").groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("cases"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("influence"), F.avg("confidence").alias("mean_confidence"))
    order = [F.desc("cases"), F.desc("influence"), F.col("id")]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "id", "cases", F.round("influence", 6).alias("influence"), F.round("mean_confidence", 3).alias("mean_confidence")).orderBy("rank")


def cross_corpus_bridges(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """rank, id, title, citing, unique_pairs, bridged: the k cases that most cases of the other domain lean on, with how many; and the
    totals of distinct pairs and of such targets."""
    pairs = edges.filter(F.col("type").isin(*CITATION_EDGES) & (F.col("scope") == "cross_domain")).select("source", "target").distinct()
    by = pairs.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("citing"))
    totals = by.agg(F.sum("citing").alias("pairs"), F.count(F.lit(1)).alias("bridged"))
    order = [F.desc("citing"), F.col("id")]
    top = by.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.join(nodes.select("id", "title"), "id", "left").select("rank", "id", "title", "citing", totals.select("pairs").scalar().alias("unique_pairs"), totals.select("bridged").scalar().alias("bridged")).orderBy("rank")
