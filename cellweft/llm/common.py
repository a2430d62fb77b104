"""What the operators share: the shared folder, materialising, reading, names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent and the session is local, a temporary folder is
    made once and kept as the session's checkpoint directory.
    """
    set_by_user = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_user:
        return set_by_user.rstrip("/")
    known = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cellweft-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage: later jobs, retries after lost executors included, read
    the files and not the plan. The files go with the checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(value: Column) -> Column:
    """Non-negative 32-bit hash of a string, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, sizes: DataFrame, total: int, share: int = 1000, least: int = 500) -> DataFrame:
    """`rows` left-joined with `facts` (one row per key), safe for keys that hold many rows.

    `sizes` has key and n, the rows of each key (all of them, or at least those with
    many); `total` is the number of rows. Keys with over total / `share` rows, of which
    there are fewer than `share`, are joined by broadcast, so that no task gets all rows of one.
    """
    hot = sizes.where(F.col("n") > max(total // share, least)).select(key)
    hot = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi").withColumn("_cw_hot", F.lit(True)))  # fewer than `share` rows
    names = [c for c in facts.columns if c != key]
    both = rows.join(hot, key, "left")
    done = both.where("_cw_hot").select(*rows.columns, *names)
    rest = both.where("_cw_hot is null").select(*rows.columns).join(facts, key, "left").select(*rows.columns, *names)
    return done.unionByName(rest)
