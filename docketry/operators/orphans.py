"""References to records that don't exist, or didn't at the reference's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.citations import canon
from docketry.operators.skew import salted
from docketry.sources.tables import checkpointed

#: Keys with at least this share of all references are hot: at most 100.
HOT_SHARE = 0.01


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of `refs` whose `ref` no parent bears at the time `at`.

    refs: tbl, field, row_key, ref string, at timestamp. parents: ref string, born, gone timestamp; a parent exists from
    born (inclusive) to gone (exclusive; null: for ever). A null ref or time is no reference; a parent without ref or born is none.

    The distinct references, with their first and last time, are left anti-joined against the parent keys: what a single
    parent covers over that whole time is settled there. Only rows of the rest are joined back and compared one by one,
    with hot keys salted. References and open keys, both narrow, are read more than once and so written to the checkpoint
    folder. Columns out are those of refs, equal rows once.
    """
    refs = checkpointed(refs.filter(F.col("ref").isNotNull() & F.col("at").isNotNull()))
    parents = parents.filter(F.col("ref").isNotNull() & F.col("born").isNotNull())
    # Of parents that never go, the first alone counts; thus one key with many parents doesn't become a large group.
    forever = parents.filter(F.col("gone").isNull()).groupBy("ref").agg(F.min("born").alias("born"), F.max("gone").alias("gone"))
    parents = forever.unionByName(parents.filter(F.col("gone").isNotNull()).distinct())
    held = lambda a, b: (F.col("born") <= a) & (F.col("gone").isNull() | (b < F.col("gone")))
    keys = refs.groupBy("ref").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    bare = parents.withColumnRenamed("ref", "p_ref")
    open_keys = checkpointed(keys.join(bare, (F.col("ref") == F.col("p_ref")) & held(F.col("first_at"), F.col("last_at")), "left_anti").select("ref", "n"))
    total = refs.select(F.count(F.lit(1))).scalar()
    hot = open_keys.filter(F.col("n") >= total * F.lit(HOT_SHARE)).select("ref")
    rows, wanted = salted(refs, open_keys.select("ref"), hot, "ref", F.col("row_key"))
    rows = rows.join(wanted, ["ref", "salt"], "left_semi")
    by = salted(rows.drop("salt"), parents.join(open_keys.select("ref"), "ref", "left_semi"), hot, "ref", F.col("row_key"))[1].withColumnsRenamed({"ref": "p_ref", "salt": "p_salt"})
    out = rows.join(by, (F.col("ref") == F.col("p_ref")) & (F.col("salt") == F.col("p_salt")) & held(F.col("at"), F.col("at")), "left_anti")
    return out.select("tbl", "field", "row_key", "ref", "at").distinct()


def case_spans(*tables: DataFrame) -> DataFrame:
    """id, citation, born, gone of every case in the tables of records, which may be delivered more than once."""
    rows = None
    for t in tables:
        part = t.select("id", "citation", "loaded_at", "deleted_at")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.max("citation").alias("citation"), F.min("loaded_at").alias("born"), F.max("deleted_at").alias("gone"))


def corpus_references(matches: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References by id (of matches) and by citation (of records), in the form that orphan_references takes.

    A record's citations count as canonical ids, at the record's first loading; statutes, regulations and what has no
    canonical form are no references to cases.
    """
    m = matches.select("match_id", "matched_at", F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("source").alias("ref")), F.struct(F.lit("target").alias("field"), F.col("target").alias("ref")))).alias("e"))
    by_id = m.select(F.lit("matches").alias("tbl"), "e.field", F.col("match_id").alias("row_key"), "e.ref", F.col("matched_at").alias("at"))
    r = records.groupBy("id").agg(F.min("loaded_at").alias("at"), F.max("citations").alias("citations"))
    r = r.select("id", "at", F.explode(F.array_distinct("citations")).alias("raw")).withColumn("c", canon(F.col("raw"))).filter(F.col("c.kind") == "case")
    by_cite = r.select(F.lit("records").alias("tbl"), F.lit("citations").alias("field"), F.col("id").alias("row_key"), F.col("c.id").alias("ref"), "at")
    return by_id, by_cite


def corpus_orphans(matches: DataFrame, records: DataFrame, lead_records: DataFrame) -> DataFrame:
    """orphan_references of matches.source, matches.target and the case citations of records, in all records together."""
    by_id, by_cite = corpus_references(matches, records)
    cases = case_spans(records, lead_records)
    cited = cases.withColumn("c", canon(F.col("citation"))).filter(F.col("c.kind") == "case")
    # Both kinds of reference in one run, told apart by a prefix of the key.
    marked = lambda kind, c: F.concat(F.lit(kind), c).alias("ref")
    refs = [rows.withColumn("ref", marked(kind, F.col("ref"))) for kind, rows in (("i:", by_id), ("c:", by_cite))]
    parents = cases.select(marked("i:", F.col("id")), "born", "gone").unionByName(cited.select(marked("c:", F.col("c.id")), "born", "gone"))
    out = orphan_references(refs[0].unionByName(refs[1]), parents)
    return out.withColumn("ref", F.substring("ref", 3, 1 << 30))


def orphan_counts(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans and all references by table, field and month (of the reference's time)."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    all_refs = refs.filter(F.col("ref").isNotNull()).select("tbl", "field", "row_key", "ref", "at").distinct().groupBy("tbl", "field", month).agg(F.count(F.lit(1)).alias("n_refs"))
    lost = orphans.groupBy("tbl", "field", month).agg(F.count(F.lit(1)).alias("n_orphans"))
    return all_refs.join(lost, ["tbl", "field", "month"], "left").select("tbl", "field", "month", "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"))
