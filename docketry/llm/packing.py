"""Filling containers of a fixed capacity with items, planned on the histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Lengths are fitted in this many steps of the capacity, and patterns have up to this many items.
STEPS, DEPTH = 512, 3
#: Items of one length are numbered in groups of about this many. One length may be that of a third of all items.
RANK_GROUP = 500_000


def patterns(steps: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to write `steps` as a sum of 1 to `depth` positive numbers, largest first in each."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if head and left == 0:
            out.append(head)
        elif len(head) < depth:
            out_of = depth - len(head)
            for x in range(min(left, head[-1] if head else left), (left - 1) // out_of, -1):
                extend((*head, x), left - x)

    extend((), steps)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with a small |a x - b|, by accelerated projected gradients (restarted where progress turns)."""
    gram, target = a @ a.T, a.T @ b
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    x = np.zeros(a.shape[1])
    y, momentum = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y) - target))
        if float((y - new) @ (new - x)) > 0:
            momentum = 1.0
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def plan(histogram: dict[int, int], capacity: int, steps: int = STEPS, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Contents (the lengths in one container) and how many containers have them, for counts of lengths up to the capacity.

    Patterns of few items that fill a container exactly, on lengths rounded up to steps, are fitted to the histogram by
    non-negative least squares; their repeat counts are rounded down and filled with real lengths, longest first. What is
    left goes, longest first, into the fullest container that still has room, else into new ones. All of it is done on
    counts: the work depends on the capacity and not on the number of items.
    """
    left = {n: c for n, c in sorted(histogram.items()) if c > 0 and 0 < n <= capacity}
    steps = min(steps, capacity)
    step_of = lambda n: -(-n * steps // capacity)
    stock: dict[int, list[int]] = defaultdict(list)
    for n in left:
        stock[step_of(n)].append(n)
    made: dict[tuple[int, ...], int] = defaultdict(int)
    usable = [p for p in patterns(steps, depth) if all(x in stock for x in p)]
    if usable:
        a, b = np.zeros((steps, len(usable))), np.array([float(sum(left[n] for n in stock.get(s + 1, ()))) for s in range(steps)])
        for j, p in enumerate(usable):
            for x in p:
                a[x - 1, j] += 1
        counts = nonnegative_least_squares(a, b)
        for j in np.argsort(-counts, kind="stable"):
            repeat = int(counts[j])
            while repeat > 0:
                need: dict[int, int] = defaultdict(int)
                for x in usable[j]:
                    need[x] += 1
                if any(not stock[x] for x in need):
                    break
                lengths = tuple(stock[x][-1] for x in usable[j])
                fit = min(repeat, *(left[stock[x][-1]] // k for x, k in need.items()))
                if fit == 0:  # the last items of a length: one container takes them singly with the next length
                    lengths = []
                    for x in usable[j]:
                        if not stock[x]:
                            break
                        n = stock[x][-1]
                        left[n] -= 1
                        lengths.append(n)
                        if not left[n]:
                            stock[x].pop()
                    made[tuple(lengths)] += 1
                    repeat -= 1
                    continue
                made[lengths] += fit
                repeat -= fit
                for x, k in need.items():
                    n = stock[x][-1]
                    left[n] -= k * fit
                    if not left[n]:
                        stock[x].pop()
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    open_rooms: list[int] = []

    def put(room: int, contents: tuple[int, ...], count: int) -> None:
        if room not in rooms or not rooms[room]:
            if room not in open_rooms:
                insort(open_rooms, room)
        rooms[room][contents] = rooms[room].get(contents, 0) + count

    for contents, count in made.items():
        put(capacity - sum(contents), contents, count)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[n]
        while count:
            i = bisect_left(open_rooms, n)
            if i == len(open_rooms):
                each = capacity // n
                full, rest = divmod(count, each)
                if full:
                    put(capacity - each * n, (n,) * each, full)
                if rest:
                    put(capacity - rest * n, (n,) * rest, 1)
                break
            room = open_rooms[i]
            contents, there = next(iter(rooms[room].items()))
            each = min(room // n, count)
            take = min(there, count // each)
            if take == there:
                del rooms[room][contents]
                if not rooms[room]:
                    open_rooms.pop(i)
            else:
                rooms[room][contents] = there - take
            put(room - each * n, contents + (n,) * each, take)
            count -= each * take
    return sorted((contents, count) for by in rooms.values() for contents, count in by.items())


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[int], list[int]]]:
    """For each length, ascending starts of runs of item ranks and the container of each run's first item. An item of rank r
    in a run that starts at s goes into the run's container plus r - s."""
    runs: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    used: dict[int, int] = defaultdict(int)
    first = 0
    for contents, count in planned:
        for n in contents:
            runs[n][0].append(used[n])
            runs[n][1].append(first)
            used[n] += count
        first += count
    return [(n, *r) for n, r in sorted(runs.items())]


def pieces(rows: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """key, piece_no, start_token, n_tokens: one piece of every item up to the capacity, else pieces of the capacity and the rest."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("int")
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int"))
    out = rows.select(F.col(key), n.alias("size"), F.explode(cut).alias("piece_no"))
    start = (F.col("piece_no") * capacity).cast("int")
    return out.select(F.col(key), "piece_no", start.alias("start_token"), F.least(F.col("size") - start, F.lit(capacity)).alias("n_tokens"))


def ranked(items: DataFrame, length: str, histogram: dict[int, int], *order: str, group: int = RANK_GROUP) -> DataFrame:
    """`items` with `rank`, a number from 0 on without gaps among the items of equal length.

    The items of a length are numbered in as many groups as its count asks for. How many groups each length has, and the ranks
    at which they begin, are broadcast: a row for each length and for each `group` items, so a hundred thousand rows for
    fifty thousand million items.
    """
    spark = items.sparkSession
    groups = spark.createDataFrame([(n, 1 + c // group) for n, c in histogram.items()], T.StructType([T.StructField(length, T.IntegerType()), T.StructField("n_groups", T.LongType())]))
    items = items.join(F.broadcast(groups), length).withColumn("part", F.pmod(F.xxhash64(*order), F.col("n_groups"))).drop("n_groups")
    sizes = items.groupBy(length, "part").agg(F.count(F.lit(1)).alias("in_group"))
    before = F.coalesce(F.sum("in_group").over(Window.partitionBy(length).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(length, "part", before.alias("offset"))
    local = F.row_number().over(Window.partitionBy(length, "part").orderBy(*order)) - 1
    return items.withColumn("rank", local).join(F.broadcast(offsets), [length, "part"]).withColumn("rank", F.col("rank") + F.col("offset")).drop("part", "offset")


def pack(items: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """`items` (of `pieces`) with the container_id that holds each.

    No container holds more than the capacity and no item is split. Items without tokens take no room and lie in container 0.
    Equal keys are told apart by piece_no; fully equal rows are items of their own, in no defined order. An empty table gives
    no rows. To the driver come the counts of lengths only, at most one number for each length up to the capacity.
    """
    spark = items.sparkSession
    sized = items.filter(F.col("n_tokens") > 0)
    histogram = {r[0]: r[1] for r in sized.groupBy("n_tokens").count().collect()}
    where = spark.createDataFrame(slots(plan(histogram, capacity)), T.StructType([T.StructField("n_tokens", T.IntegerType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("containers", T.ArrayType(T.LongType()))]))
    placed = ranked(sized, "n_tokens", histogram, key, "piece_no").join(F.broadcast(where), "n_tokens")
    run = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    container = F.element_at("containers", run) + F.col("rank") - F.element_at("starts", run)
    columns: list[Column] = [F.col(c) for c in items.columns]
    return placed.select(*columns, container.alias("container_id")).unionByName(items.filter(F.col("n_tokens") <= 0).select(*columns, F.lit(0).cast("bigint").alias("container_id")))
