"""Aggregation and joins for keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a chunk, which is combined where it lies, and states that one reducer of a round gets of a key.
CHUNK_ROWS, FAN_IN = 65_536, 16


def tree_rounds(n_rows: int, chunk: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> int:
    """Rounds that bring the chunks of so many rows down to one state for each key."""
    chunks, rounds = -(-n_rows // chunk), 1
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def tree_aggregate(df: DataFrame, key: str, member: str, time: str, *, chunk: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows, distinct members, first and last time of each key, by multi-level tree aggregation.

    The input is tagged in chunks of a fixed number of rows; a chunk lies in one task, so what it has of a key is combined there.
    Chunks are the leaves of a tree with fan_in**rounds places, spread evenly by hash: in each round the states of about
    `fan_in` neighbours become one, until one is left. Rounds follow from the number of chunks (tree_rounds), whatever the
    number of partitions is, and no reducer gets the states of all tasks of a key, even if it has a third of all rows.

    Distinct members are kept exactly: pairs (key, member) are made distinct first within groups of chunks, then over all, so
    that a pair in every chunk isn't brought together at once either; their counts, by partition, enter the same rounds.

    Columns out: key_value string, n_rows, n_members bigint, first_at, last_at timestamp. A null key is a group of its
    own; null members are rows but no members; null times are passed over (null if a key has no other). An empty table
    gives no rows. Only the three named columns are read, so others may have any name.
    """
    rounds = tree_rounds(df.select(F.lit(1)).count(), chunk, fan_in)
    leaves = fan_in**rounds
    place = F.monotonically_increasing_id()  # the task in its upper bits, the row of the task in its lower
    tagged = df.select(F.col(key).cast("string").alias("k"), F.col(member).alias("m"), F.col(time).alias("t"), F.pmod(F.xxhash64(F.shiftright(place, 33), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / chunk)), F.lit(leaves)).alias("node"))
    rows = tagged.groupBy("k", F.floor(F.col("node") / fan_in).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("d"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    group = F.floor(F.col("node") / fan_in ** (rounds // 2)) if rounds > 1 else F.lit(0)
    pairs = tagged.filter(F.col("m").isNotNull()).select("k", "m", group.alias("group")).distinct().select("k", "m").distinct()
    none = F.lit(None).cast(df.select(time).schema[0].dataType)
    parts = pairs.groupBy("k", F.pmod(F.spark_partition_id(), F.lit(max(1, leaves // fan_in))).cast("bigint").alias("node")).agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("d")).select("k", "node", "n", "d", none.alias("lo"), none.alias("hi"))
    state = rows.unionByName(parts)
    merged = [F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    for _ in range(rounds - 1):
        state = state.groupBy("k", F.floor(F.col("node") / fan_in).alias("node")).agg(*merged)
    return state.groupBy("k").agg(*merged).select(F.col("k").alias("key_value"), F.col("n").alias("n_rows"), F.col("d").alias("n_members"), F.col("lo").alias("first_at"), F.col("hi").alias("last_at"))


def heavy_keys(stats: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The rows of `stats` (of tree_aggregate) whose non-null key holds at least `share` of the rows of `rows`. There are at
    most 1/share of them, so the result may be broadcast."""
    total = rows.select(F.count(F.lit(1))).scalar()
    return stats.filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= total * F.lit(share)))


def salted(left: DataFrame, right: DataFrame, hot: DataFrame, key: str, spread: Column, *, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `key` with a column `salt` to join on as well.

    Rows of `left` with a key in `hot` get one of `salts` values by `spread`, rows of `right` with such a key are repeated
    for each; all others get 0. `hot` has a column `key` only and a bounded number of rows (it is broadcast).
    """
    mark = F.broadcast(hot.select(F.col(key), F.lit(True).alias("is_hot")))
    left = left.join(mark, key, "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.hash(spread), F.lit(salts))).otherwise(F.lit(0))).drop("is_hot")
    right = right.join(mark, key, "left").withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("is_hot")
    return left, right
