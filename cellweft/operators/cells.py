"""Quality control, normalisation and feature selection. A missing count is a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.running import running_totals
from cellweft.operators.tables import materialize


def cell_qc(counts: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Per cell: total, number of features, and share of the total in a set of features."""
    if features is None:
        inside = counts.withColumn("_in", F.lit(0.0))
    else:
        inside = counts.join(features.select("feature").distinct().withColumn("_in", F.lit(1.0)), "feature", "left")
    total = F.sum("x")
    share = F.when(total > 0, F.sum(F.when(F.col("_in") == 1, F.col("x")).otherwise(0.0)) / total)
    return inside.groupBy("sample", "cell").agg(total.alias("total"), F.count(F.when(F.col("x") > 0, 1)).alias("n_features"), share.alias("frac"))


def feature_qc(counts: DataFrame) -> DataFrame:
    """Per feature: cells that have it and the mean over all cells. The number of cells is one value."""
    n = counts.agg(F.countDistinct("cell").alias("n_all"))
    own = counts.groupBy("feature").agg(F.count(F.when(F.col("x") > 0, 1)).alias("n_cells"), F.sum("x").alias("total"))
    return own.join(F.broadcast(n)).select("feature", "n_cells", (F.col("total") / F.col("n_all")).alias("mean"))  # n is one row


def filter_cells(counts: DataFrame, least_total: float, least_features: int) -> DataFrame:
    """Counts of cells (of a sample) within fixed bounds."""
    good = cell_qc(counts).where((F.col("total") >= least_total) & (F.col("n_features") >= least_features)).select("sample", "cell")
    return counts.join(good, ["sample", "cell"], "left_semi")


def filter_mad(df: DataFrame, col: str, k: float, by: str) -> DataFrame:
    """Rows within median plus or minus k * 1.4826 * MAD of their group. Medians are exact."""
    mid = df.groupBy(by).agg(F.median(col).alias("_mid"))
    near = df.join(mid, by).withColumn("_dev", F.abs(F.col(col) - F.col("_mid")))
    mad = near.groupBy(by).agg(F.median("_dev").alias("_mad"))
    return near.join(mad, by).where(F.col("_dev") <= k * 1.4826 * F.col("_mad")).select(*df.columns)


def paired_cells(rna: DataFrame, atac: DataFrame) -> DataFrame:
    """Every cell of either table with where it was seen: both, rna or atac."""
    a, b = rna.select("cell").distinct().withColumn("_r", F.lit(1)), atac.select("cell").distinct().withColumn("_a", F.lit(1))
    seen = F.when(F.col("_r").isNotNull() & F.col("_a").isNotNull(), "both").when(F.col("_r").isNotNull(), "rna").otherwise("atac")
    return a.join(b, "cell", "full_outer").select("cell", seen.alias("seen"))


def lognorm(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log(1 + scale * x / total of the cell); zeros stay zeros, so the table stays sparse."""
    total = F.sum("x").over(Window.partitionBy("cell"))
    return counts.select("sample", "cell", "feature", F.log1p(F.col("x") / total * scale).alias("x"))


def tfidf(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log(1 + tf * idf * scale) with tf = x / cell total and idf = cells / cells with the feature."""
    n = counts.agg(F.countDistinct("cell").alias("_n"))
    df = counts.where("x > 0").groupBy("feature").agg(F.count("*").alias("_df"))
    tf = F.col("x") / F.sum("x").over(Window.partitionBy("cell"))
    out = counts.withColumn("_tf", tf).join(df, "feature").join(F.broadcast(n))  # n is one row
    return out.select("cell", "feature", F.log1p(F.col("_tf") * F.col("_n") / F.col("_df") * scale).alias("x"))


def feature_moments(norm: DataFrame) -> DataFrame:
    """Mean and sample variance of each feature over all cells, zeros counted."""
    n = norm.agg(F.countDistinct("cell").alias("_n"))
    s = norm.groupBy("feature").agg(F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_ss"))
    mean = F.col("_s") / F.col("_n")
    var = F.when(F.col("_n") > 1, (F.col("_ss") - F.col("_n") * mean * mean) / (F.col("_n") - 1))
    return s.join(F.broadcast(n)).select("feature", mean.alias("mean"), var.alias("var"), F.col("_n").alias("n"))  # n is one row


def hvg(norm: DataFrame, k: int, bins: int = 10) -> DataFrame:
    """The k features of highest variance standardised among features of like mean.

    Features are dealt into `bins` by mean; z is the variance's z-score in its bin
    (0 in a bin without spread). Ties by feature. The windows run over one row per feature.
    """
    m = feature_moments(norm).withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "feature")))
    own = Window.partitionBy("bin")
    z = (F.col("var") - F.avg("var").over(own)) / F.nullif(F.stddev_samp("var").over(own), F.lit(0.0))
    z = F.coalesce(z, F.lit(0.0))
    ranked = m.withColumn("z", F.round(z, 9)).withColumn("rank", F.row_number().over(Window.orderBy(F.col("z").desc(), "feature")))
    return ranked.where(F.col("rank") <= k).select("feature", "mean", "var", "bin", "z", "rank")


def scale(norm: DataFrame) -> DataFrame:
    """z-scores of the stored values, by moments over all cells; null for constant features."""
    m = feature_moments(norm).select("feature", "mean", F.sqrt(F.nullif("var", F.lit(0.0))).alias("_sd"))
    return norm.join(m, "feature").select("cell", "feature", ((F.col("x") - F.col("mean")) / F.col("_sd")).alias("x"))


def pseudobulk(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Sums per feature and (sample, cell type), with subtotals over cell types and over samples; level tells which keys are merged."""
    joined = counts.select("cell", "feature", "x").join(cells.select("cell", "sample", "cell_type"), "cell")
    keys = [F.col("feature"), F.col("sample"), F.col("cell_type")]
    sets = joined.groupingSets([keys, keys[:2], keys[:1]], *keys)
    return sets.agg(F.sum("x").alias("x"), F.count("*").alias("cells"), F.grouping_id().cast("int").alias("level"))


def composition(cells: DataFrame) -> DataFrame:
    """Share of each cell type in each stage."""
    n = cells.groupBy("stage", "cell_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("stage")))


def rank_markers(norm: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Per group the k features of largest log fold change of means, with detection rate and rank-sum z.

    Ranks are mid-ranks over all cells; the cells without a row are one block of
    ties at zero, added analytically. Stored values are taken to be positive. Ranks come from
    counts of values and running sums over range partitions, so a feature that all cells have is many tasks.
    """
    size = groups.groupBy("grp").agg(F.count("*").alias("_m"))
    total = groups.agg(F.count("*").alias("_n"))
    # a row per feature, value and group; the mid-rank of a value follows from the number of lower ones
    counts = materialize(norm.join(groups, "cell").groupBy("feature", "x", "grp").agg(F.count("*").alias("_k")), "values")
    values = running_totals(counts.groupBy("feature", "x").agg(F.sum("_k").alias("_t")), ["feature"], ["x"], "_t", "_below")
    values = materialize(values.withColumn("_r", F.col("_below") + (F.col("_t") + 1) / 2.0), "mid-ranks")
    full = values.groupBy("feature").agg(F.sum("_t").alias("_c"), F.sum(F.col("_t") * F.col("x")).alias("_s"), F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("_ties"))
    g = counts.join(values, ["feature", "x"]).groupBy("feature", "grp").agg(F.sum("_k").alias("_k"), F.sum(F.col("_k") * F.col("x")).alias("_gs"), F.sum(F.col("_k") * F.col("_r")).alias("_gr"))
    j = g.join(full, "feature").join(size, "grp").join(F.broadcast(total))  # total is one row
    zeros = F.col("_n") - F.col("_c")
    ranks = F.col("_gr") + F.col("_k") * zeros + (F.col("_m") - F.col("_k")) * (zeros + 1) / 2.0
    rest = F.col("_n") - F.col("_m")
    ties = F.col("_ties") + F.pow(zeros.cast("double"), 3) - zeros
    var = F.col("_m") * rest / 12.0 * ((F.col("_n") + 1) - ties / (F.col("_n") * (F.col("_n") - 1.0)))
    z = F.when((rest > 0) & (var > 0), (ranks - F.col("_m") * (F.col("_n") + 1) / 2.0) / F.sqrt(var))
    inside, outside = F.col("_gs") / F.col("_m"), F.when(rest > 0, (F.col("_s") - F.col("_gs")) / rest).otherwise(0.0)
    lfc = F.round(F.log2(inside + 1e-9) - F.log2(outside + 1e-9), 6)
    out = j.select("grp", "feature", F.round(F.col("_k") / F.col("_m"), 9).alias("detected"), lfc.alias("lfc"), F.round(z, 6).alias("z"))
    place = Window.partitionBy("grp").orderBy(F.col("lfc").desc(), "feature")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
