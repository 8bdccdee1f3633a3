"""Search over cases and pages: BM25 on a postings table, reference resolution, and dense retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.citations import canon
from docketry.functions.text import snippet, squash, tokens
from docketry.sources.tables import checkpointed

K1, B = 1.5, 0.75


def query_terms(query: str, spark: SparkSession) -> dict[str, int]:
    """The query's search tokens and how often each occurs: as many as it has words."""
    one = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term"))
    return {r[0]: r[1] for r in one.groupBy("term").agg(F.count(F.lit(1))).orderBy("term").collect()}


def term_counts(docs: DataFrame, terms: list[str], key: list[str], text: str = "text") -> DataFrame:
    """key, n_terms, tf (one count for each of `terms`) of every document. An empty or null text has length 0 and no terms."""
    rows = docs.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_terms"))
    times = lambda term: F.size(F.filter("_terms", lambda t: t == F.lit(term)))
    return rows.select(*key, F.size("_terms").alias("n_terms"), F.array(*map(times, terms)).cast("array<int>").alias("tf"))


def bm25(docs: DataFrame, query: str, key: list[str], text: str = "text") -> DataFrame:
    """key and score (> 0) of each document for the query, by Okapi BM25 over all documents.

    A document's text is read once, where it lies, and leaves only its length and its counts of the query's words; nothing is
    shuffled but one row of totals. idf and average length are over all documents, empty ones included. Equal keys are documents
    of their own.
    """
    terms = query_terms(query, docs.sparkSession)
    counts = checkpointed(term_counts(docs, list(terms), key, text))
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("mean"), *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    mean = total["mean"] or 1.0
    score = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        idf = math.log(1 + (total["n"] - total[f"df{i}"] + 0.5) / (total[f"df{i}"] + 0.5))
        tf = F.get("tf", F.lit(i))
        score = score + times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_terms") / mean))
    return counts.filter(F.exists("tf", lambda n: n > 0)).select(*key, score.alias("score"))


def search_pages(pages: DataFrame, known: DataFrame, query: str, case_id: str | None = None, limit: int = 8) -> DataFrame:
    """rank, case_id, page, score, title, snippet of the best pages. A case filter doesn't change scores."""
    scored = bm25(pages, query, ["case_id", "page"])
    if case_id is not None:
        scored = scored.filter(F.col("case_id") == case_id)
    top = scored.orderBy(F.desc("score"), "case_id", "page").limit(limit)
    order = Window.orderBy(F.desc("score"), "case_id", "page")
    titles = known.select(F.col("id").alias("case_id"), "title")
    terms = list(query_terms(query, pages.sparkSession))
    return top.withColumn("rank", F.row_number().over(order)).join(pages, ["case_id", "page"]).join(titles, "case_id", "left").select("rank", "case_id", "page", F.round("score", 3).alias("score"), "title", snippet(F.col("text"), terms, 400).alias("snippet")).orderBy("rank")


#: Characters of a run on which names and titles are joined; a name found within a title has as many at least.
GRAM = 6


def resolve(refs: DataFrame, known: DataFrame, ref: str = "ref") -> DataFrame:
    """ref, case_id: the case that each reference means; null for none.

    An id wins, then a canonical citation; a well-formed citation of no case is nothing, whatever names look like it; then a
    name without `In re` or `Matter of`: equal to a title, or longer than five characters and within one. Of several the
    smallest id is taken. Names meet the titles that have the rarest of their runs of GRAM characters before they are compared.
    """
    rows = refs.select(F.col(ref).alias("ref")).distinct().withColumn("s", squash(F.col("ref"))).filter(F.coalesce("s", F.lit("")) != "").withColumn("c", canon(F.col("s")))
    by_id = rows.join(known.select(F.col("id").alias("s"), F.col("id").alias("by_id")), "s", "left")
    own = known.filter(~F.col("canon_id").startswith("nocite:")).groupBy("canon_id").agg(F.max("id").alias("by_cite"))
    by_cite = by_id.join(own.withColumnRenamed("canon_id", "cid"), F.col("c.id") == F.col("cid"), "left").drop("cid")
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"^(in re|matter of)\s+", ""))
    strip = lambda c: F.regexp_replace(c, r"^[ ,.]+|[ ,.]+$", "")
    open_refs = by_cite.filter(F.col("by_id").isNull() & F.col("by_cite").isNull() & ((F.col("c.kind") != "case") | F.col("c.id").startswith("other:"))).withColumn("name", strip(bare(F.col("s")))).filter(F.col("name") != "")
    names = known.select("id", F.lower("title").alias("title"), bare(F.col("title")).alias("bare"))
    asked = open_refs.select("ref", "name")
    whole = asked.join(names.select("id", F.explode(F.array_distinct(F.array("title", "bare"))).alias("name")), "name").select("ref", "id")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, GRAM)))).alias("gram")
    in_titles = names.filter(F.length("title") >= GRAM).select("id", "title", grams(F.col("title")))
    counts = in_titles.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    long = asked.filter(F.length("name") >= GRAM).select("ref", "name", grams(F.col("name"))).join(counts, "gram", "left")
    keys = long.groupBy("ref", "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).filter(F.col("k.n") > 0).select("ref", "name", F.col("k.gram").alias("gram"))
    part = keys.join(in_titles, "gram").filter(F.contains("title", "name")).select("ref", "id")
    by_name = whole.unionByName(part).groupBy("ref").agg(F.min("id").alias("by_name"))
    return by_cite.join(by_name, "ref", "left").select("ref", F.coalesce("by_id", "by_cite", "by_name").alias("case_id"))


def search_cases(known: DataFrame, pages: DataFrame, query: str, domain: str | None = None, limit: int = 10) -> DataFrame:
    """case_id, title, score, best_page, snippet of the best cases: twice the score of the case's own data (title three times), the
    best page's score, and 100 if the query means the case. The snippet is of the best page, the earliest of equal ones; null
    without one."""
    meta = known.select("id", F.concat_ws(" ", "title", "title", "title", "citation", "docket_number").alias("text"))
    own = bm25(meta, query, ["id"]).withColumnRenamed("score", "meta")
    text = bm25(pages, query, ["case_id", "page"]).groupBy("case_id").agg(F.max("score").alias("body"), F.max_by("page", F.struct("score", -F.col("page"))).alias("best_page")).withColumnRenamed("case_id", "id")
    spark = known.sparkSession
    direct = resolve(spark.range(1).select(F.lit(query).alias("ref")), known).select(F.col("case_id").alias("id"), F.lit(100.0).alias("direct"))
    rows = own.join(text, "id", "full").join(direct.filter(F.col("id").isNotNull()), "id", "full").join(known.select("id", "title", "domain"), "id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumn("score", 2 * zero("meta") + zero("body") + zero("direct")).filter(F.col("score") > 0)
    if domain is not None:
        rows = rows.filter(F.col("domain") == domain)
    top = rows.orderBy(F.desc("score"), "id").limit(limit).select(F.col("id").alias("case_id"), "title", F.round("score", 3).alias("score"), "best_page")
    shown = pages.select("case_id", F.col("page").alias("best_page"), snippet(F.col("text"), list(query_terms(query, spark))).alias("snippet"))
    return top.join(shown, ["case_id", "best_page"], "left").select("case_id", "title", "score", "best_page", "snippet").orderBy(F.desc("score"), "case_id")


def case_summaries(known: DataFrame, pages: DataFrame, edges: DataFrame, citation_types: tuple[str, ...], top: int = 15) -> DataFrame:
    """One row for each case: its data and provenance, its pages, its most mentioned statutes (at most `top`, by mentions, then id),
    its doctrines and judges, and how many citation edges leave and reach it. Lists are texts in a fixed order."""
    listed = lambda kind, item, order: edges.filter(F.col("type") == kind).groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(*order, item.alias("x")))), lambda x: x["x"]), "; ").alias("listed"))
    law = edges.filter(F.col("type") == "MENTIONS_STATUTE").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("count"), "target"))).filter(F.col("rank") <= top)
    law = law.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target", "count"))), lambda x: F.concat(x["target"], F.lit(" x"), x["count"].cast("string"))), "; ").alias("statutes"))
    doctrines = listed("INVOKES_DOCTRINE", F.concat_ws(" ", "target", "provenance", F.format_number("confidence", 3)), ["target"]).withColumnRenamed("listed", "doctrines")
    judges = listed("AUTHORED_BY", F.concat_ws(" ", "target", "provenance"), ["target"]).withColumnRenamed("listed", "judges")
    cites = edges.filter(F.col("type").isin(*citation_types))
    out = cites.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_cites"))
    into = cites.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_cited_by"))
    n = pages.groupBy(F.col("case_id").alias("id")).agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))
    about = [c for c in ("decision_date", "decision_year", "docket_number", "term", "source_url", "page_count") if c in known.columns]
    rows = known.select("id", "title", "citation", "domain", "court", *about, F.lit("deterministic").alias("provenance"))
    for part in (n, law, doctrines, judges, out, into):
        rows = rows.join(part, "id", "left")
    return rows.fillna(0, ["n_pages", "n_cites", "n_cited_by"]).fillna("", ["statutes", "doctrines", "judges", "pages"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: What the queries of one pass over the corpus may take in a task, and how many of them are one matrix product.
PASS_BYTES, PRODUCT = 64 << 20, 1024


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int = 8, *, key: str = "vec_id", vector: str = "embedding", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `corpus` by cosine for each row of `queries`. Ties go to the smaller id;
    a vector of zeros has similarity 0 with all. Null vectors are no rows.

    Queries are taken in passes of bounded size (a hundred thousand queries of 64 numbers); each pass meets all rows once, in matrix
    products, and every task keeps the k best of what it has read, so that it hands on k rows for a query and no more.
    """
    ask = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    ask = ask.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))
    n, width = ask.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    parts = max(1, -(-n * 8 * (width or 1) // pass_bytes))
    out = None
    for i in range(parts):
        rows = ask.filter(F.col("part") % parts == i).select("query_id", "q").collect()  # bounded by pass_bytes
        if not rows:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows], dtype=np.float64))))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            kept_ids, kept = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                if len(batch):
                    vectors, own = _unit(np.stack(batch["v"].to_numpy()).astype(np.float64)).T, batch["id"].to_numpy()
                    keep = min(k, kept.shape[1] + len(own))
                    new_ids, new = np.empty((len(ids), keep), dtype=np.int64), np.empty((len(ids), keep))
                    for a in range(0, len(ids), PRODUCT):
                        z = slice(a, a + PRODUCT)
                        scores = np.hstack((kept[z], matrix[z] @ vectors))
                        all_ids = np.hstack((kept_ids[z], np.broadcast_to(own, (len(scores), len(own)))))
                        order = np.lexsort((all_ids, -np.round(scores, 9)), axis=1)[:, :keep]
                        new_ids[z], new[z] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(scores, order, 1)
                    kept_ids, kept = new_ids, new
            if kept.shape[1]:
                yield pd.DataFrame({"query_id": np.repeat(ids, kept.shape[1]), "id": kept_ids.ravel(), "score": kept.ravel()})

        part = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(best, "query_id bigint, id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = ask.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), F.round("score", 4).alias("score"))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)
