from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import byte_bpe, packing


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.sentencepiece_model(byte_bpe.read_ranks()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {p: i for i, p in enumerate(byte_bpe.read_ranks())}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_those_of_another_library_and_round_trip(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text


def test_special_strings_are_text_and_long_texts_work(codec, reference):
    for text in ("<|endoftext|> and <unk> <s>", "a" * 5000, "word " * 20_000, "​ \t\n\n  x", "日本語🙂" * 500):
        assert codec.encode(text) == reference.encode_ordinary(text) and codec.decode(codec.encode(text)) == text


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    words = [f" w{i}" for i in range(200)]
    assert codec.encode("".join(words)) and codec.encode("x" + "".join(words[:50])) and len(codec.known) < 600


def test_columns(spark):
    df = spark.createDataFrame([(1, "Harbor pass."), (2, ""), (3, None)], "doc_id int, text string")
    got = df.select("doc_id", byte_bpe.token_ids(spark, F.col("text")).alias("ids"), byte_bpe.token_count(spark, F.col("text")).alias("n")).collect()
    assert [len(r["ids"]) == r["n"] for r in got] == [True] * 3 and got[1]["ids"] == [] and got[2]["ids"] == []
    back = df.select(byte_bpe.ids_text(spark, byte_bpe.token_ids(spark, F.col("text"))).alias("t")).collect()
    assert [r["t"] for r in back] == ["Harbor pass.", "", ""]


def test_patterns_sum_up():
    p = packing.patterns(8, 3)
    assert len(p) == len(set(p)) == 10 and all(sum(x) == 8 and len(x) <= 3 and list(x) == sorted(x, reverse=True) for x in p)


def test_least_squares():
    import numpy as np

    a = np.array([[1.0, 0, 1], [0, 2, 1]])
    x = packing.nonnegative_least_squares(a, np.array([3.0, 5.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 5], atol=1e-3)
    assert (packing.nonnegative_least_squares(np.eye(2), np.array([-1.0, 2.0])) == [0, pytest.approx(2)]).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=20), st.sampled_from([1, 2, 7, 64]))
def test_plan_uses_every_item_once_and_fits(histogram, steps):
    planned = packing.plan(histogram, 64, steps, 3)
    used: Counter = Counter()
    for contents, count in planned:
        assert sum(contents) <= 64 and count > 0
        for n in contents:
            used[n] += count
    assert used == Counter({k: v for k, v in histogram.items() if v})
    runs = packing.slots(planned)
    seen: Counter = Counter()
    for n, starts, firsts in runs:
        assert starts == sorted(starts) and len(starts) == len(firsts)
        for r in range(used[n]):
            i = max(j for j, s in enumerate(starts) if s <= r)
            seen[firsts[i] + r - starts[i]] += n
    assert all(v <= 64 for v in seen.values())


def test_little_room_is_left():
    rnd = random.Random(5)
    h = Counter(min(2048, max(1, int(rnd.lognormvariate(5.6, 0.8)))) for _ in range(20_000))
    n = sum(c for _, c in packing.plan(dict(h), 2048))
    assert sum(k * v for k, v in h.items()) / n / 2048 > 0.995


def test_pack(spark):
    sizes = [0, None, 1, 10, 11, 25, 5, 5, 5, 5, 5, 9] + [3] * 40
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, n_tokens int")
    pieces = packing.pieces(df, 10).cache()
    assert pieces.filter("doc_id = 5").orderBy("piece_no").select("start_token", "n_tokens").collect() == [(0, 10), (10, 10), (20, 5)]
    got = packing.pack(pieces, 10).collect()
    assert len(got) == pieces.count() and len({(r["doc_id"], r["piece_no"]) for r in got}) == len(got)
    room: Counter = Counter()
    for r in got:
        room[r["container_id"]] += r["n_tokens"]
    assert max(room.values()) <= 10 and len(room) <= sum(s or 0 for s in sizes) / 10 * 1.2 + 1
    assert packing.pack(pieces.limit(0), 10).count() == 0


def test_ranks_have_no_gaps(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 else i % 5, 0) for i in range(500)], "doc_id int, n int, piece_no int")
    by: dict = {}
    counts = {r[0]: r[1] for r in df.groupBy("n").count().collect()}
    for r in packing.ranked(df, "n", counts, "doc_id", "piece_no", group=50).collect():
        by.setdefault(r["n"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 500
