"""The Parquet tables of one directory, and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name`, a Parquet file or folder of that name in `directory`."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for what is written to be read again.

    The cluster names it in spark.checkpoint.dir. Only where that is unset on one machine (tests) a temporary folder is used; on a
    cluster its absence is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="docketry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and read again from the shared checkpoint folder. A plain localCheckpoint would be lost with its executor,
    so it is never used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
