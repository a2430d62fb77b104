"""Running sums over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.tables import dealt, materialize, parts


def running(rows: DataFrame, by: list[str], order: list[str], value: str, into: str, what: Callable[[str], Column] = F.sum, after: bool = False, own: bool = False, size: int = 0) -> DataFrame:
    """`rows` with `what` (a sum, minimum or maximum) of `value` over the rows of the same group (`by`, not null) that come before in `order`.

    `after`: that come after it instead; `own`: the row itself too. Null where there are none.
    Rows are dealt to range partitions of (group, order), so a group that holds all rows is
    many tasks; what a partition must know of the others is one value, from a window
    over one row per group and partition. `size`: the number of rows, if it is known; partitions then hold a bounded number of them. Of rows that are equal in `order` any come first.
    """
    keys = [*by, *order]
    n = parts(rows, size) if size else None
    ranges = rows.repartitionByRange(n, *keys) if n else rows.repartitionByRange(*keys)
    placed = materialize(ranges.sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    turned = lambda names: [F.col(c).desc() if after else F.col(c).asc() for c in names]
    others = Window.partitionBy(*by).orderBy(*turned(["_part"])).rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(*by, "_part").agg(what(value).alias("_sum"))
    per = per.withColumn("_other", what("_sum").over(others)).drop("_sum")
    inside = Window.partitionBy(*by, "_part").orderBy(*turned(order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    both = dealt(placed, size, *by, "_part").join(dealt(per, size, *by, "_part"), [*by, "_part"]).withColumn("_here", what(value).over(inside))
    pair = F.array_compact(F.array("_other", "_here"))
    joined = {F.sum: F.col("_other") + F.col("_here"), F.min: F.array_min(pair), F.max: F.array_max(pair)}[what]
    return both.withColumn(into, F.coalesce(joined, "_other", "_here")).drop("_part", "_other", "_here")


def running_totals(rows: DataFrame, by: list[str], order: list[str], value: str, into: str, size: int = 0) -> DataFrame:
    """`rows` with the sum of `value` over the rows of the same group that come before in `order`, 0 for the first."""
    return running(rows, by, order, value, into, size=size).withColumn(into, F.coalesce(into, F.lit(0)))


def mid_ranks(rows: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """Rows by, value, `into`: the rank of each value within its group, the mean of their places for equal ones. Values are not null."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running_totals(counts, by, [value], "_n", "_below")
    return placed.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(into))
