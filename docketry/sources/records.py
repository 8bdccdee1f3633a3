"""Case records from JSON lines, their manifests, and the graph's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docketry.operators.graph import EDGE_TYPES, NODE_LABELS

RECORD = "id string, title string, citation string, decision_date string, decision_year int, issuing_body string, court string, docket_number string, term int, source_url string, sha256 string, page_count int, pages array<struct<page: int, text: string, source_pdf_page: int>>, citations_detected array<string>, text string"


def read_records(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of JSON lines files. Blank lines are skipped; lines that don't parse, or have no id, title or pages,
    go to quarantine with file, id and reason. A missing text is the pages' texts in lines. All fields have declared types."""
    return parsed_records(spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("source")), domain)


def parsed_records(lines: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """read_records for lines (line, source) that are there already."""
    lines = lines.filter(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", RECORD + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "invalid JSON")
        .when(F.coalesce("r.id", F.lit("")) == "", "missing id")
        .when(F.coalesce("r.title", F.lit("")) == "", "missing title")
        .when(F.coalesce(F.size("r.pages"), F.lit(0)) < 1, "missing pages")
    )
    rows = parsed.withColumn("reason", reason)
    good = rows.filter(F.col("reason").isNull()).select("r.*").drop("_corrupt").withColumn("domain", F.lit(domain)).withColumn("text", F.coalesce("text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n")))
    return good, rows.filter(F.col("reason").isNotNull()).select("source", "line", F.col("r.id").alias("id"), "reason")


def checked_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """path, problem of files that the manifest (path, sha256) doesn't list or whose content differs, and of listed ones that are
    missing. Files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("found"))
    both = files.join(manifest.select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256"), "path", "full")
    problem = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("sha256"), "checksum mismatch")
    return both.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def membership(loaded: DataFrame, selected: DataFrame) -> DataFrame:
    """id, problem: ids in one of two sets only."""
    both = loaded.select("id").distinct().withColumn("a", F.lit(1)).join(selected.select("id").distinct().withColumn("b", F.lit(1)), "id", "full")
    return both.filter(F.col("a").isNull() | F.col("b").isNull()).select("id", F.when(F.col("a").isNull(), "not loaded").otherwise("not selected").alias("problem"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by type as Parquet. Labels and types are checked against the known ones first; a partition is
    replaced whole, so writing again leaves one copy."""
    for df, column, known in ((nodes, "label", NODE_LABELS), (edges, "type", EDGE_TYPES)):
        odd = [r[0] for r in df.filter(F.col(column).isNull() | ~F.col(column).isin(*known)).select(column).distinct().limit(5).collect()]
        if odd:
            raise ValueError(f"unknown {column}: {odd}")
    for df, column, name in ((nodes, "label", "nodes"), (edges, "type", "edges")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as written; missing evidence is empty."""
    none = F.array().cast("array<struct<page: int, quote: string>>")
    return tuple(spark.read.parquet(f"{path}/{name}").withColumn("evidence", F.coalesce("evidence", none)) for name in ("nodes", "edges"))


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines for other programs; nested columns stay nested."""
    df.write.mode("overwrite").json(path)


def import_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents {nodes: [...], edges: [...]}, one to a file."""
    evidence = "evidence array<struct<page: int, quote: string>>"
    node = f"id string, label string, props variant, provenance string, confidence double, {evidence}"
    edge = f"type string, source string, target string, props variant, provenance string, confidence double, {evidence}"
    docs = spark.read.schema(f"nodes array<struct<{_ddl(node)}>>, edges array<struct<{_ddl(edge)}>>").json(path, multiLine=True)
    get = lambda name, kind: F.try_variant_get(F.col("props"), f"$.{name}", kind)
    nodes = docs.select(F.inline("nodes")).select("id", "label", get("title", "string").alias("title"), F.coalesce(get("display", "string"), get("citation", "string")).alias("display"), get("domain", "string").alias("domain"), "provenance", "confidence", "evidence")
    edges = docs.select(F.inline("edges")).select("type", "source", "target", get("scope", "string").alias("scope"), get("bases", "array<string>").alias("bases"), get("count", "bigint").alias("count"), "provenance", "confidence", "evidence")
    return nodes, edges


def _ddl(fields: str) -> str:
    return T._parse_datatype_string(fields).simpleString()[len("struct<") : -1]


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines."""
    df.write.mode("append").json(path)


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the last by `order`."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")


def sharded_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of run files with `run`, the file's name without its end and shard number (`qa_kg_s3.jsonl` is of qa_kg)."""
    return spark.read.schema(schema).json(path).withColumn("run", run_of(F.input_file_name()))


def run_of(path: F.Column) -> F.Column:
    """The run that a file's name stands for."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1), r"_s\d+$", "")


def cache_key(version: str, **columns) -> F.Column:
    """SHA-256 of a request in a fixed order of fields: equal requests have equal keys."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *[F.col(c).alias(n) for n, c in sorted(columns.items())]), {"ignoreNullFields": "false"}), 256)


def cached_replies(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with their replies from the cache; `cached` says whether there is one."""
    return requests.join(cache.select(key, "text", F.lit(True).alias("hit")), key, "left").withColumn("cached", F.coalesce("hit", F.lit(False))).drop("hit")


def run_totals(manifests: DataFrame, counters: list[str]) -> DataFrame:
    """The sums of run manifests' counters; missing ones count 0."""
    return manifests.agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters])


# The nodes that a parsed reading query may consist of, and functions that run code or wait.
READING = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Join LateralJoin Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith "
    "UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition Window Generate Pivot Unpivot Sample UnresolvedHint UnresolvedOrdinal UnresolvedTableValuedFunction ResolvedInlineTable Expand UnresolvedTVFAliases".split()
)
RUNNING_CODE = ("reflect", "java_method", "try_reflect", "sleep")


class read_only_sql:
    """A query over named views, run only if it reads: `read_only_sql(spark, nodes=..., edges=...)(query)`.

    The whole parsed plan is walked, queries in WITH and in expressions included, and every node must be one of READING; so
    nothing that writes, however it is wrapped, is run. Functions that run code are refused. The text isn't looked at, so a query
    may mention `create` or `set` in a string.
    """

    def __init__(self, spark: SparkSession, **views: DataFrame) -> None:
        self.spark = spark
        for name, df in views.items():
            df.createOrReplaceTempView(name)

    def __call__(self, query: str, limit: int = 50) -> DataFrame:
        self._check(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query))
        return self.spark.sql(query).limit(limit)

    def _check(self, plan) -> None:
        kind = plan.getClass().getSimpleName()
        if kind not in READING:
            raise PermissionError(f"not a read: {kind}")
        for group in (plan.children(), plan.innerChildren()):
            for i in range(group.size()):
                self._check(group.apply(i))
        self._check_expressions(plan.expressions())

    def _check_expressions(self, expressions) -> None:
        for i in range(expressions.size()):
            e = expressions.apply(i)
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction" and e.nameParts().last().lower() in RUNNING_CODE:
                raise PermissionError(f"not a read: {e.nameParts().last()}")
            if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                self._check(e.plan())
            self._check_expressions(e.children())
