"""Line formats whose meaning depends on earlier lines, read in parallel.

A file is cut into splits anywhere between lines. What a line must know of the lines
before it (how many headers, the last of them, how much came since) is made of a running
value within its split and one carried in from the splits before, which takes a row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of their split in it, and a number that grows within the split: value, file, split, n."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("split"))
    return lines.withColumn("n", F.monotonically_increasing_id())


def under_headers(lines: DataFrame, header: Column, title: Column, amount: Column) -> DataFrame:
    """Lines with number (headers so far in all files, by path), title (of the last header) and before (sum of `amount` since it).

    Lines ahead of a file's first header have a null title. A split is one window; what
    goes from split to split is carried by windows over one row per split.
    """
    up = Window.partitionBy("file", "split").orderBy("n")
    past = up.rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumns({"_h": F.coalesce(header, F.lit(False)), "_a": F.when(header, 0).otherwise(amount).cast("long"), "_title": F.when(header, title)})
    own = own.withColumns({"_k": F.sum(F.col("_h").cast("int")).over(up), "_sum": F.coalesce(F.sum("_a").over(past), F.lit(0)), "_title": F.last("_title", ignorenulls=True).over(up)})
    base = F.coalesce(F.last(F.when(F.col("_h"), F.col("_sum")), ignorenulls=True).over(up), F.lit(0))
    own = own.withColumn("_sum", F.col("_sum") - base)
    end = F.struct(F.col("_title").alias("title"), (F.col("_sum") + F.col("_a")).alias("tail"))
    per = own.groupBy("file", "split").agg(F.max("_k").alias("heads"), F.max_by(end, "n").alias("end"))
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("run", F.count(F.when(F.col("heads") > 0, 1)).over(order))  # splits since the last one with a header share it
    since = F.sum("end.tail").over(Window.partitionBy("file", "run").orderBy("split"))
    per = per.withColumns({"since": since, "last": F.when(F.col("heads") > 0, F.col("end.title"))})
    everything = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(
        "file", "split", F.coalesce(F.sum("heads").over(everything), F.lit(0)).alias("_heads"), F.coalesce(F.lag("since").over(order), F.lit(0)).alias("_since"), F.last("last", ignorenulls=True).over(before).alias("_last")
    )
    out = own.join(carried, ["file", "split"])
    fresh = F.col("_k") > 0
    return out.select(*lines.columns, (F.col("_heads") + F.col("_k")).alias("number"), F.when(fresh, F.col("_title")).otherwise(F.col("_last")).alias("title"), F.when(fresh, F.col("_sum")).otherwise(F.col("_sum") + F.col("_since")).alias("before"), F.col("_h").alias("is_header"))
