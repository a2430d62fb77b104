"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cellweft-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage of iterations, and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where tables are dealt by their size.
MOST = 250_000


def parts(df: DataFrame, rows: int, most: int | None = None) -> int | None:
    """Partitions of some `most` (MOST) rows each for `rows` rows; none where that is no more than the cores."""
    n = -(-rows // (most or MOST))
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, rows: int, *keys: str, most: int | None = None) -> DataFrame:
    """`df` by `keys` in so many partitions that one holds some `most` (MOST) of `rows` rows; as it is where that is no more than the cores.

    Spark merges the partitions of its own shuffles until they are as few as the cores, so that a task's
    sorts and hash tables grow with the table. A number that is given here stays, also for the joins and groupings that follow by these keys.
    """
    n = parts(df, rows, most)
    return df.repartition(n, *keys) if n else df
