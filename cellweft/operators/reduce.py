"""Reduced spaces of cells over selected features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.spectral import block_sum, leading_vectors
from cellweft.operators.tables import materialize


def dense_rows(x: DataFrame, features: DataFrame) -> tuple[DataFrame, int]:
    """One array per cell over the selected features in order; missing rows are zeros.

    `features` is a selection of bounded size (such as the top of hvg), numbered here.
    """
    number = features.select("feature").distinct().withColumn("_i", F.row_number().over(Window.orderBy("feature")) - 1)
    number = materialize(number, "selected")
    k = number.count()
    own = x.join(number, "feature").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("_i", "x"))).alias("_m"))  # at most k entries
    every = x.select("cell").distinct().join(own, "cell", "left")
    at = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return every.select("cell", at.alias("vec")), k


def pca(x: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """The k leading principal components of each cell (not centred scores, as MLlib gives them): cell, vec.

    The covariance is a matrix of features by features on the driver, so the selection
    must stay in the low thousands.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows, n = dense_rows(x, features)
    data = rows.select("cell", array_to_vector("vec").alias("features"))
    return PCA(k=min(k, n), inputCol="features", outputCol="pc").fit(data).transform(data).select("cell", vector_to_array("pc").alias("vec"))


def lsi(x: DataFrame, k: int, features: DataFrame | None = None, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame, list[float]]:
    """Truncated singular value decomposition of the sparse table x (cell, feature, x), missing rows being zeros.

    Returns scores (cell, vec: left vectors times singular values), loadings (feature, vec: right vectors)
    and the singular values, largest first; `features` (feature) restricts the table.
    Blocks of k + 4 values per feature are multiplied by the table and its transpose, two joins each
    time; no table of features by features exists, and only the blocks' small
    inner products reach the driver. The leading vectors of the scaled square of the table are
    refined until their residuals are at most `tolerance`, else an error is raised. Repeated
    (cell, feature) rows add up. There are fewer vectors where the table's rank is lower.
    """
    own = x.select("cell", "feature", "x").where("x <> 0")
    if features is not None:
        own = own.join(features.select("feature").distinct(), "feature", "left_semi")
    own = materialize(own.groupBy("cell", "feature").agg(F.sum(F.col("x").cast("double")).alias("x")), "lsi")
    # a bound of the largest eigenvalue of X'X: the largest sum of |X'| |X| along a row
    reach = own.join(own.groupBy("cell").agg(F.sum(F.abs("x")).alias("_s")), "cell").groupBy("feature").agg(F.sum(F.abs("x") * F.col("_s")).alias("_r"))
    bound = reach.agg(F.max("_r")).first()[0] or 1.0

    def square(block: DataFrame, width: int) -> DataFrame:
        """2 X'X / bound - 1, whose spectrum is in [-1, 1]."""
        there = own.join(block.withColumnRenamed("id", "feature").withColumnRenamed("x", "_b"), "feature").groupBy("cell").agg(block_sum("_b", width, F.col("x")).alias("_b"))
        back = own.join(there, "cell").groupBy(F.col("feature").alias("id")).agg(block_sum("_b", width, F.col("x") * (2.0 / bound)).alias("_y"))
        return back.join(block, "id").select("id", F.zip_with("_y", "x", lambda y, z: y - z).alias("y"))

    rows = own.select(F.col("feature").alias("id")).distinct().withColumn("w", F.lit(1.0))
    found, values = leading_vectors(rows, square, k, tolerance=tolerance)
    values = [float(np.sqrt(max((v + 1) / 2 * bound, 0.0))) for v in values]
    kept = sum(v > 1e-6 * values[0] for v in values)
    loads = materialize(found.select(F.col("id").alias("feature"), F.slice("v", 1, kept).alias("vec")), "loadings")
    scores = own.join(loads, "feature").groupBy("cell").agg(block_sum("vec", kept, F.col("x")).alias("vec"))
    return scores, loads, values[:kept]
