from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docketry.operators import ledger
from docketry.sources import records, settings
from docketry.streaming import ledger as stream

T0 = datetime(2031, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def test_quota_edges_are_strict(spark):
    e = spark.createDataFrame([("u", at(0)), ("u", at(59)), ("u", at(60)), ("u", at(3600)), ("v", at(60)), (None, at(1)), ("u", None)], "k string, ts timestamp")
    got = {(r["k"], r["ts"]): r for r in ledger.quota_used(e, "k", "ts", {"minute": 2, "hour": 9, "day": 9}).collect()}
    assert len(got) == 6
    assert [got["u", at(s)]["used_minute"] for s in (0, 59, 60, 3600)] == [1, 2, 2, 1]
    assert got["u", at(3600)]["used_hour"] == 3 and got["u", at(60)]["blocked_by"] == "minute" and got["u", at(0)]["blocked_by"] is None
    assert got["u", at(59)]["wait_minute"] == 1.0


def test_pruning_and_budget(spark):
    e = spark.createDataFrame([("u", at(0), 1), ("u", at(1), 2), ("u", at(86400), 3)], "k string, ts timestamp, i int")
    assert [r["i"] for r in ledger.pruned(e, "ts", F.lit(at(86400))).orderBy("i").collect()] == [2, 3]
    assert ledger.within_budget(e, "k", ["ts"], 2).count() == 2


def test_pairs_are_last_in_first_out(spark, rows):
    e = spark.createDataFrame([("s", 1, "start"), ("s", 2, "start"), ("s", 3, "end"), ("s", 4, "end"), ("s", 5, "end"), ("t", 1, "start")], "k string, t int, kind string")
    assert rows(ledger.paired_spans(e, ["k"], "t", "kind")) == [("s", 1, 4), ("s", 2, 3)]


def test_tally_and_usage(spark, rows):
    c = spark.createDataFrame([("q", "m1", 1, 10), ("q", "m1", 1, 30), ("q", "m2", 2, 5)], "turn string, msg string, pass_no int, tokens int")
    assert rows(ledger.token_tally(c, "turn", "msg", "tokens", "pass_no")) == [("q", 35)]
    usage = spark.createDataFrame([("a", 1.0, 1, 2), ("b", 2.0, 3, 4), ("c", 9.99, 5, 6), ("d", 10.01, 7, 8)], "id string, latency_s double, input_tokens int, output_tokens int")
    messages = spark.createDataFrame([("t1", "a"), ("t1", "b")], "turn_id string, message_id string")
    turns = spark.createDataFrame([("t1", 3.0), ("t2", 10.0), ("t3", 50.0)], "turn_id string, latency_s double")
    assert rows(ledger.usage_by_turn(usage, messages, turns)) == [("t1", 4, 6, "id"), ("t2", 7, 8, "latency")]


def test_digest(spark):
    t = spark.createDataFrame([("s", f"t{i}", at(i), f"q{i}", "x" * 500) for i in range(8)], "session string, turn_id string, ts timestamp, q string, a string")
    lines = ledger.session_digest(t, "session", "turn_id", "ts", "q", "a").first()["digest"].split("\n")
    assert len(lines) == 1 + 6 * 3 and lines[1:3] == ["1. Q: q2", "   Cases discussed: none"] and lines[3] == "   Answer summary: " + "x" * 400
    c = t.withColumn("cases", F.expr("transform(sequence(1, 8), i -> struct('T' AS title, if(i = 1, null, 'id') AS case_id, '1 U.S. 1' AS citation))"))
    lines = ledger.session_digest(c, "session", "turn_id", "ts", "q", "a", "cases").first()["digest"].split("\n")
    assert lines[2] == "   Cases discussed: T (1 U.S. 1), " + ", ".join(["T (id)"] * 5)


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(i % 3, at(i * 700)) for i in range(40)], "user_id int, ts timestamp").write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    for name, f, mode in (("w", lambda d: stream.quota_windows(d, "user_id", "ts", slide="1 hour"), "complete"), ("d", lambda d: stream.first_deliveries(d, ["user_id", "ts"], "ts"), "append"), ("s", lambda d: stream.sessions(d, "user_id", "ts"), "append")):
        q = f(source).writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = spark.table(f"out_{name}")
        if name == "w":
            assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))
        if name == "d":
            assert got.count() == 40


def test_records_and_quarantine(spark, tmp_path):
    lines = [{"id": "a", "title": "T § ’", "pages": [{"page": 1, "text": "one"}, {"page": 2, "text": "two"}]}, {"id": "b", "title": "T"}, {"title": "T", "pages": [{"page": 1, "text": "x"}]}, {"id": "c", "pages": []}]
    (tmp_path / "r.jsonl").write_text("\n".join([*(json.dumps(x, ensure_ascii=False) for x in lines), "{broken", "", "  "]))
    good, bad = records.read_records(spark, str(tmp_path / "r.jsonl"), "immigration")
    row = good.first()
    assert good.count() == 1 and row["text"] == "one\ntwo" and row["title"] == "T § ’" and row["domain"] == "immigration"
    assert sorted(r["reason"] for r in bad.collect()) == ["invalid JSON", "missing id", "missing pages", "missing title"]


def test_manifest(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([("a", sha("a")), ("b", sha("x")), ("d", sha("d"))], "path string, sha256 string")
    assert {r["path"]: r["problem"] for r in records.checked_manifest(spark, str(tmp_path), m).collect()} == {"b": "checksum mismatch", "c": "unlisted", "d": "missing"}


def test_logs_shards_and_cache(spark, tmp_path, rows):
    a = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "one")], "id string, n int, v string")
    records.append_log(a, str(tmp_path / "log"))
    records.append_log(a.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert rows(records.latest(a, ["id"], ["n"])) == [("x", 2, "new"), ("y", 1, "one")]
    for name in ("qa_kg_s1.jsonl", "qa_kg_s22.jsonl", "qa_rag.jsonl"):
        (tmp_path / name).write_text('{"id": 1}\n')
    assert sorted(r["run"] for r in records.sharded_runs(spark, str(tmp_path / "qa_*.jsonl"), "id int").collect()) == ["qa_kg", "qa_kg", "qa_rag"]
    k = a.withColumn("cache_key", records.cache_key("1", model="id", text="v"))
    assert k.select("cache_key").distinct().count() == 3
    cache = k.limit(1).select("cache_key", F.lit("reply").alias("text"))
    assert sum(r["cached"] for r in records.cached_replies(k, cache).collect()) == 1
    assert tuple(records.run_totals(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), ["a", "b"]).first()) == (3, 3)
    assert rows(records.membership(a, a.filter("id = 'x'").unionByName(a.limit(1).withColumn("id", F.lit("z"))))) == [("y", "not selected"), ("z", "not loaded")]


def test_only_reads_are_run(spark):
    spark.createDataFrame([(1, "create")], "a int, b string").createOrReplaceTempView("seen")
    spark.sql("CREATE TABLE IF NOT EXISTS victim (a INT) USING parquet")
    ask = records.read_only_sql(spark)
    for q in ("SELECT * FROM seen", "WITH x AS (SELECT a FROM seen) SELECT * FROM x ORDER BY a LIMIT 3", "SELECT 'insert into' AS s, (SELECT max(a) FROM seen) AS m FROM seen GROUP BY 1 HAVING count(*) > 0", "SELECT a FROM seen UNION SELECT 2 EXCEPT SELECT 3", "VALUES (1), (2)", "SELECT a, row_number() OVER (PARTITION BY b ORDER BY a) FROM seen JOIN (SELECT explode(array(1, 2)) AS a) y USING (a) WHERE a IN (SELECT a FROM seen)"):
        ask(q).collect()
    for q in ("WITH a AS (SELECT 1 AS a) INSERT INTO victim SELECT a FROM a", "INSERT INTO victim VALUES (1)", "DROP TABLE victim", "CREATE TABLE t2 AS SELECT 1", "SET x = 1", "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT * FROM seen WHERE a = (SELECT java_method('java.lang.Math', 'abs', 1))", "CACHE TABLE seen", "TRUNCATE TABLE victim", "FROM seen INSERT INTO victim SELECT a", "DELETE FROM victim"):
        with pytest.raises(PermissionError):
            ask(q)
    assert spark.table("victim").count() == 0


def test_settings(spark, tmp_path, monkeypatch):
    raw = {"name": "all", "sources": [{"domain": "a", "paths": ["x"]}, {"domain": "b", "paths": ["y"], "statute_patterns": ["usc"]}], "cross_domain": [["a", "b"]], "settings": {"model": "m"}}
    (tmp_path / "d.json").write_text(json.dumps(raw))
    monkeypatch.setenv("DOCKETRY_MODEL", "other")
    d = settings.load_dataset(str(tmp_path / "d.json"))
    assert d.cross_domain == (("a", "b"),) and d.settings["model"] == "other" and d.sources[1].statute_patterns == ("usc",)
    (tmp_path / "e.json").write_text(json.dumps(raw | {"cross_domain": [["a", "z"]]}))
    with pytest.raises(ValueError):
        settings.load_dataset(str(tmp_path / "e.json"))
    assert settings.golden_questions(spark, [{"id": "q1"}]).first()["expect"] == "answer"
    with pytest.raises(ValueError):
        settings.golden_questions(spark, [{"id": "q1"}, {"id": "q1"}])
