from __future__ import annotations

import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.operators.orphans import corpus_orphans, orphan_references
from docketry.operators.skew import heavy_keys, salted, tree_aggregate, tree_rounds

T0 = datetime(2031, 1, 1)


def test_tree_aggregate_against_brute_force(spark, rows):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), rnd.choice(["x", "y", "z", None, str(rnd.random())]), rnd.choice([None, T0 + timedelta(hours=rnd.randrange(99))]), 7) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, m string, t timestamp, key_value int")
    want = []
    for key in {d[0] for d in data}:
        own = [d for d in data if d[0] == key]
        times = [d[2] for d in own if d[2]]
        want.append((key, len(own), len({d[1] for d in own if d[1] is not None}), min(times), max(times)))
    for fan_in in (2, 3, 16):
        assert rows(tree_aggregate(df, "k", "m", "t", fan_in=fan_in)) == sorted(want, key=repr)


def test_rounds_follow_from_the_chunks_at_any_number_of_partitions(spark, rows):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) AS k", "if(id % 2 = 0, null, cast(id % 700 as string)) AS m", "timestamp_seconds(id) AS t")
    want = rows(df.groupBy("k").agg(F.count(F.lit(1)), F.count_distinct("m"), F.min("t"), F.max("t")))
    assert [tree_rounds(n, 100, 4) for n in (0, 100, 401, 5000, 10**9)] == [1, 1, 2, 3, 12]
    counts = set()
    for partitions in (2, 4, 23):
        for chunk, fan_in in ((100, 4), (1000, 2), (10_000, 16)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = tree_aggregate(df.repartition(partitions), "k", "m", "t", chunk=chunk, fan_in=fan_in)
            assert rows(got) == want
            exchanges = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(k#")
            counts.add((tree_rounds(5000, chunk, fan_in), exchanges))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r for r, _ in counts} == {1, 3} and len(counts) == 2 and max(counts)[1] - min(counts)[1] >= 2, counts


def test_tree_aggregate_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, m string, t timestamp")
    assert tree_aggregate(df, "k", "m", "t").count() == 0
    assert heavy_keys(tree_aggregate(df, "k", "m", "t"), df, 0.02).count() == 0


def test_heavy_keys_count_nulls_as_rows_but_not_as_keys(spark, rows):
    df = spark.createDataFrame([("a", "x", T0)] * 2 + [(None, "x", T0)] * 97 + [("b", "x", T0)], "k string, m string, t timestamp")
    assert [r[0] for r in rows(heavy_keys(tree_aggregate(df, "k", "m", "t"), df, 0.02))] == ["a"]


def test_salted_join_keeps_all_pairs(spark, rows):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("h", "H"), ("h", "H2"), ("c", "C")], "k string, v string")
    hot = spark.createDataFrame([("h",)], "k string")
    a, b = salted(left, right, hot, "k", F.col("i"), salts=5)
    got = rows(a.join(b, ["k", "salt"]).select("k", "i", "v"))
    assert got == rows(left.join(right, "k").select("k", "i", "v"))


def _brute(refs, parents):
    return sorted({r for r in refs if r[3] is not None and r[4] is not None and not any(p[0] == r[3] and p[1] is not None and p[1] <= r[4] and (p[2] is None or r[4] < p[2]) for p in parents)}, key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_orphans_against_brute_force(spark, rows, seed):
    rnd = random.Random(seed)
    at = lambda: rnd.choice([None, *[T0 + timedelta(days=rnd.randrange(6)) for _ in range(5)]])
    refs = [("t", "f", f"r{rnd.randrange(40)}", rnd.choice([None, "hot", "hot", "hot", "a", "b", "c", "gone"]), at()) for _ in range(60)]
    parents = [(rnd.choice(["hot", "a", "b", "c", None]), at(), at()) for _ in range(12)]
    r = spark.createDataFrame(refs, "tbl string, field string, row_key string, ref string, at timestamp")
    p = spark.createDataFrame(parents, "ref string, born timestamp, gone timestamp")
    assert rows(orphan_references(r, p)) == _brute(refs, parents)


def test_corpus_orphans(spark, rows):
    record = "id string, citation string, citations array<string>, loaded_at timestamp, deleted_at timestamp"
    day = lambda n: T0 + timedelta(days=n)
    records = spark.createDataFrame(
        [
            ("a", "1 I&N Dec. 10", ["2 U.\nS. 20", "2 U. S. 20", "8 U.S.C. § 1101", "9 F.3d 9", None], day(5), None),
            ("a", "1 I&N Dec. 10", ["2 U.\nS. 20", "2 U. S. 20", "8 U.S.C. § 1101", "9 F.3d 9", None], day(9), None),
            ("b", "2 U.S. 20", None, day(4), day(6)),
            ("c", None, [], day(1), None),
            ("d", "3 F.4th 3", ["2 U.S. 20"], day(7), None),
        ],
        record,
    )
    lead = spark.createDataFrame([], record)
    matches = spark.createDataFrame([("m1", "a", "b", day(5)), ("m2", "a", "b", day(6)), ("m3", "x", None, day(9)), ("m3", "x", None, day(9)), ("m4", "c", "d", day(6))], "match_id string, source string, target string, matched_at timestamp")
    got = {r[:4] for r in rows(corpus_orphans(matches, records, lead))}
    assert got == {("matches", "target", "m2", "b"), ("matches", "source", "m3", "x"), ("matches", "target", "m4", "d"), ("records", "citations", "a", "f3d:9_9"), ("records", "citations", "d", "us:2_20")}
    empty = spark.createDataFrame([], matches.schema)
    assert corpus_orphans(empty, spark.createDataFrame([], record), lead).count() == 0
