"""Ordering of cells along time, also a closed cycle, and the timing of features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.running import mid_ranks
from cellweft.operators.spectral import leading_vectors
from cellweft.operators.tables import materialize
from cellweft.operators.walk import walk_basis


def pseudotime_geodesic(edges: DataFrame, roots: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """Shortest weighted distance of each node from the roots (edges a, b, distance count both ways); unreachable nodes have no row.

    Rounds go on until nothing changes (as many as the longest shortest path has edges); an error is raised after `most_rounds`.
    """
    both = edges.select("a", "b", "distance").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    both = materialize(both.groupBy("a", "b").agg(F.min("distance").alias("w")), "geo-edges")
    cur = materialize(roots.select("cell").distinct().withColumn("t", F.lit(0.0)), "geo")
    before = None
    for _ in range(most_rounds):
        step = both.join(cur.select(F.col("cell").alias("a"), "t"), "a").select(F.col("b").alias("cell"), (F.col("t") + F.col("w")).alias("t"))
        cur = materialize(cur.unionByName(step).groupBy("cell").agg(F.min("t").alias("t")), "geo")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("cell", "t").cast("decimal(38,0)"))).first())
        if now == before:
            return cur
        before = now
    raise RuntimeError(f"distances not settled after {most_rounds} rounds")


def pseudotime_diffusion(edges: DataFrame, root: int, m: int = 2, tolerance: float = 1e-7) -> DataFrame:
    """Distance from the root in the m leading non-trivial vectors of the random walk on the graph: cell, t.

    Edges count both ways and once. Vectors are of length one in the walk's stationary inner product
    (weights are numbers of neighbours), in which the walk is symmetric; they are found by
    block subspace iteration until their residuals are at most `tolerance`, and an
    error is raised if they do not get there. No row if the root has no edge.
    """
    both = edges.select("a", "b").where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "walk-edges")
    degree = materialize(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("w")), "walk-nodes")
    found, _ = leading_vectors(degree, None, m, tolerance=tolerance, without_constant=True, extend=walk_basis(both, degree))
    at = found.where(F.col("id") == root).select(F.col("v").alias("_root"))
    square = F.aggregate(F.zip_with("v", "_root", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return found.join(F.broadcast(at)).select(F.col("id").alias("cell"), F.sqrt(square).alias("t"))  # the root's row


def cyclic_phase(emb: DataFrame, i: int, j: int) -> DataFrame:
    """Angle of each cell in the plane of two components, in [0, 2 pi)."""
    angle = F.atan2(F.get("vec", F.lit(j)).cast("double"), F.get("vec", F.lit(i)).cast("double"))
    return emb.select("cell", F.pmod(angle + F.lit(2 * math.pi), F.lit(2 * math.pi)).alias("phase"))


def circular_mean(phases: DataFrame, by: str) -> DataFrame:
    """Circular mean and resultant length per group."""
    s, c = F.avg(F.sin("phase")), F.avg(F.cos("phase"))
    return phases.groupBy(by).agg(F.pmod(F.atan2(s, c) + F.lit(2 * math.pi), F.lit(2 * math.pi)).alias("mean"), F.sqrt(s * s + c * c).alias("length"))


def bin_time(pt: DataFrame, n: int, mode: str = "width", low: float = 0.0, high: float = 2 * math.pi) -> DataFrame:
    """Adds bin 0..n-1: equal widths of [low, high), or equal counts in the order of t, then cell (as ntile).

    Equal counts: cells are ranked within 1000 stretches of time, plus the cells of the
    stretches before, so that no task ranks them all.
    """
    if mode == "width":
        at = F.floor((F.col("t") - low) * n / (high - low)).cast("int")
        return pt.withColumn("bin", F.greatest(F.least(at, F.lit(n - 1)), F.lit(0)))
    ends = pt.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.count("*").alias("_all"))  # one row
    part = F.coalesce(F.floor((F.col("t") - F.col("_lo")) * 1000 / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0))
    own = pt.join(F.broadcast(ends)).withColumn("_part", F.when(F.col("t").isNull(), -1).otherwise(part))
    before = own.groupBy("_part").agg(F.count("*").alias("_c"))
    before = before.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most 1002 rows
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("t", "cell")) - 1 + F.col("_before")
    ranked = own.join(F.broadcast(before), "_part").withColumns({"_r": rank, "_size": F.expr(f"_all div {n}"), "_more": F.expr(f"_all % {n}")})
    ntile = F.expr("case when _r < _more * (_size + 1) then _r div (_size + 1) else _more + (_r - _more * (_size + 1)) div _size end")
    return ranked.withColumn("bin", ntile.cast("int")).select(*pt.columns, "bin")


def smooth_trend(trend: DataFrame, reach: int, bins: int | None = None) -> DataFrame:
    """Moving mean over bins within `reach`; with `bins` given, time is a cycle of so many bins and wraps."""
    if bins is None:
        near = Window.partitionBy("feature").orderBy("bin").rangeBetween(-reach, reach)
        return trend.select("feature", "bin", F.avg("y").over(near).alias("y"))
    copies = trend.withColumn("_own", F.lit(True))
    for shift in (-bins, bins):
        edge = trend.where(F.col("bin") + shift >= -reach).where(F.col("bin") + shift < bins + reach)
        copies = copies.unionByName(edge.withColumns({"bin": F.col("bin") + shift, "_own": F.lit(False)}))
    near = Window.partitionBy("feature").orderBy("bin").rangeBetween(-reach, reach)
    return copies.withColumn("y", F.avg("y").over(near)).where("_own").select("feature", "bin", "y")


def kernel_trend(x: DataFrame, bins: int, width: float, period: float | None = None) -> DataFrame:
    """Gaussian kernel mean of each feature along time: feature, bin, t (middle of the bin), y.

    `x` has feature, t, y with t irregular, in [0, period) on a cycle or, without a
    period, anywhere. Values are summed in `bins` bins first and the bins' sums are weighted
    by their distance (around the cycle where there is one), so a feature costs bins
    squared, however many rows it has. `width` is the kernel's standard deviation in units of t.
    """
    if period is None:
        ends = x.agg(F.min("t"), F.max("t")).first()
        low, span = float(ends[0] or 0.0), float(ends[1] or 0.0) - float(ends[0] or 0.0) or 1.0
    else:
        low, span = 0.0, period
    step = span / bins
    at = F.least(F.greatest(F.floor((F.col("t") - low) * bins / span), F.lit(0)), F.lit(bins - 1)).cast("int")
    sums = x.where("y is not null and t is not null").groupBy("feature", at.alias("_from")).agg(F.sum("y").alias("_y"), F.count("*").alias("_n"))
    away = lambda i, j: min(abs(i - j), bins - abs(i - j)) * step if period is not None else abs(i - j) * step
    weights = [(i, j, math.exp(-(away(i, j) ** 2) / (2 * width * width))) for i in range(bins) for j in range(bins)]
    table = x.sparkSession.createDataFrame(weights, "_from int, bin int, _w double")
    both = sums.join(F.broadcast(table), "_from").groupBy("feature", "bin")  # bins squared rows
    mean = F.sum(F.col("_w") * F.col("_y")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0.0))
    return both.agg(mean.alias("y")).select("feature", "bin", (low + (F.col("bin") + 0.5) * step).alias("t"), "y")


def time_association(trend: DataFrame) -> DataFrame:
    """Spearman correlation of each feature with time, by mid-ranks; null for a constant. Ranks come from counts of values over range partitions."""
    own = trend.select("feature", "bin", "y").where("y is not null and bin is not null")
    ranked = own.join(mid_ranks(own, ["feature"], "y", "_a"), ["feature", "y"]).join(mid_ranks(own, ["feature"], "bin", "_b"), ["feature", "bin"])
    n = F.count("*")
    top = n * F.sum(F.col("_a") * F.col("_b")) - F.sum("_a") * F.sum("_b")
    va, vb = n * F.sum(F.col("_a") * F.col("_a")) - F.pow(F.sum("_a"), 2), n * F.sum(F.col("_b") * F.col("_b")) - F.pow(F.sum("_b"), 2)
    return ranked.groupBy("feature").agg((top / F.sqrt(F.when(va * vb > 0, va * vb))).alias("rho"), n.alias("n"))


def bin_association(x: DataFrame) -> DataFrame:
    """Do a feature's values (feature, bin, y) differ between bins? feature, n, bins, f: the ratio of the variance between bins to that within.

    Sums and squares of each bin are all that is grouped. Null where there is one bin, one row per bin, or no spread within.
    """
    own = x.where("y is not null and bin is not null").withColumn("y", F.col("y").cast("double"))
    per = own.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    all_ = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("bins"), mean.alias("_m"), F.sum(F.col("n") * F.col("v")).alias("_in"))
    far = per.join(all_.select("feature", "_m"), "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m"))).alias("_between"))
    inside = F.col("_in") / F.nullif((F.col("n") - F.col("bins")).cast("double"), F.lit(0.0))
    ratio = F.col("_between") / F.nullif((F.col("bins") - 1).cast("double"), F.lit(0.0)) / F.when(inside > 1e-12 * (F.col("_between") + 1e-300), inside)
    return all_.join(far, "feature").select("feature", "n", "bins", ratio.alias("f"))


def stage_summary(pt: DataFrame, cells: DataFrame) -> DataFrame:
    """Quartiles of time per stage and the stages' order by median."""
    q = lambda p: F.percentile("t", F.lit(p))
    out = pt.join(cells.select("cell", "stage"), "cell").groupBy("stage").agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"))
    return out.withColumn("place", F.dense_rank().over(Window.orderBy("median")))


def peak_time(trend: DataFrame) -> DataFrame:
    """Bin of the maximum (the first one) and onset, the first bin at or above the middle between extremes."""
    top = F.max("y").over(Window.partitionBy("feature"))
    low = F.min("y").over(Window.partitionBy("feature"))
    t = trend.withColumns({"_top": top, "_half": (top + low) / 2})
    return t.groupBy("feature").agg(F.min(F.when(F.col("y") == F.col("_top"), F.col("bin"))).alias("peak"), F.min(F.when(F.col("y") >= F.col("_half"), F.col("bin"))).alias("onset"))


def _pearson(x: Column, y: Column) -> Column:
    n = F.count("*")
    top = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    bottom = (n * F.sum(x * x) - F.sum(x) * F.sum(x)) * (n * F.sum(y * y) - F.sum(y) * F.sum(y))
    return top / F.sqrt(F.when(bottom > 1e-12, bottom))


def lag(a: DataFrame, b: DataFrame, pairs: DataFrame, most: int, least_bins: int = 5) -> DataFrame:
    """Shift (b later than a by lag bins) of highest correlation for each pair fa, fb; ties to the smaller shift."""
    shifts = pairs.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    x = a.select(F.col("feature").alias("fa"), F.col("bin").alias("_ta"), F.col("y").alias("_ya"))
    y = b.select(F.col("feature").alias("fb"), F.col("bin").alias("_tb"), F.col("y").alias("_yb"))
    j = shifts.join(x, "fa").withColumn("_tb", F.col("_ta") + F.col("lag")).join(y, ["fb", "_tb"])
    c = j.groupBy("fa", "fb", "lag").agg(F.round(_pearson(F.col("_ya"), F.col("_yb")), 9).alias("corr"), F.count("*").alias("n")).where(F.col("n") >= least_bins)
    best = Window.partitionBy("fa", "fb").orderBy(F.col("corr").desc_nulls_last(), F.abs("lag"), "lag")
    return c.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("fa", "fb", "lag", "corr")


def order_elements(peaks: DataFrame) -> DataFrame:
    """Features by onset with their percent rank, class, and the nearest earlier one (as-of by a running last)."""
    w = Window.orderBy("onset", "feature")  # one row per feature
    pr = F.percent_rank().over(Window.orderBy("onset"))
    kind = F.when(pr < 1 / 3, "early").when(pr < 2 / 3, "middle").otherwise("late")
    return peaks.select("feature", "onset", F.round(pr, 6).alias("rank"), kind.alias("kind"), F.lag("feature").over(w).alias("before"), (F.col("onset") - F.lag("onset").over(w)).alias("gap"))


def asof_join(left: DataFrame, right: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """Left rows with the last value of the right table at or before their time, by one union and a running last."""
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)}).unionByName(right.select(by, t, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")
