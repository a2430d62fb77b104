"""Leading vectors of large symmetric operators by restarted block Krylov subspaces.

A block of vectors is one array per row of a table, so a product with the operator is a
join and a grouped sum. From the start block X come the Chebyshev blocks T1(A) X, T2(A) X, ..., which
span a Krylov subspace and stay well conditioned where powers do not. Only the
inner products of these blocks, one small matrix, reach the driver: the Rayleigh-Ritz
step there gives the best vectors of the subspace and their residuals. They start
the next round until the residuals are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.operators.tables import materialize


def block_sum(x: str, width: int, weight: Column | None = None) -> Column:
    """Grouped sum of arrays of `width` doubles, element by element."""
    part = lambda i: F.col(x)[i] if weight is None else F.col(x)[i] * weight
    return F.array(*[F.sum(part(i)) for i in range(width)])


def inner_products(rows: DataFrame, width: int) -> np.ndarray:
    """Sum over rows (w, basis) of w * basis basis': a matrix of `width` squared values per task is all that is added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                b = np.stack(pdf["basis"].to_numpy())
                total += (b * pdf["w"].to_numpy()[:, None]).T @ b
        yield pd.DataFrame({"part": [total.ravel().tolist()]})

    parts = rows.select("w", "basis").mapInPandas(run, "part array<double>")
    sums = parts.select(F.posexplode("part").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()  # width squared rows
    out = np.zeros(width * width)
    for r in sums:
        out[r["i"]] = r["g"]
    return out.reshape(width, width)


def combine(rows: DataFrame, weights: np.ndarray, into: str) -> DataFrame:
    """Rows (id, w, basis) with basis replaced by its products with the columns of `weights`."""
    columns = [c for c in rows.columns if c != "basis"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                done = np.stack(pdf["basis"].to_numpy()) @ weights
                yield pdf[columns].assign(**{into: list(done)})

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInPandas(run, f"{schema}, {into} array<double>")


def _ritz(gram: np.ndarray, block: int, steps: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Values, weights (of the basis) of the leading vectors of the subspace, and the largest residual of the wanted ones.

    The basis has the blocks T0 .. Tsteps+1; the last only serves products: A Tk = (Tk+1 + Tk-1) / 2, A T0 = T1.
    """
    inner = block * (steps + 1)
    move = np.zeros((len(gram), inner))  # A times the inner basis, in terms of the whole
    for k in range(steps + 1):
        own = np.arange(block)
        if k == 0:
            move[block + own, own] = 1.0
        else:
            move[(k + 1) * block + own, k * block + own] = 0.5
            move[(k - 1) * block + own, k * block + own] = 0.5
    size, axes = np.linalg.eigh(gram[:inner, :inner])
    keep = size > 1e-13 * max(size[-1], 1e-300)
    root = axes[:, keep] / np.sqrt(size[keep])
    h = root.T @ (gram[:inner] @ move) @ root
    values, turned = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values)[:block]
    weights = root @ turned[:, order]
    rest = move @ weights
    rest[:inner] -= weights * values[order]
    residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", rest, gram, rest), 0))
    return values[order], weights, float(residual[:wanted].max(initial=0.0))


def _basis(cur: DataFrame, apply: Callable[[DataFrame, int], DataFrame], block: int, steps: int) -> DataFrame:
    """Rows (id, w, x) to (id, w, basis), by a product at a time."""
    cur = materialize(cur.select("id", "w", F.lit(None).cast("array<double>").alias("before"), "x", F.col("x").alias("basis")), "block")
    for k in range(steps + 1):
        y = apply(cur.select("id", "x"), block)
        both = cur.join(y, "id", "left").withColumn("y", F.coalesce("y", F.array_repeat(F.lit(0.0), block)))
        nxt = F.zip_with("y", "before", lambda a, b: 2.0 * a - b) if k else F.col("y")
        cur = materialize(both.select("id", "w", F.col("x").alias("before"), nxt.alias("x"), F.concat("basis", nxt).alias("basis")), "block")
    return cur.select("id", "w", "basis")


def leading_vectors(
    rows: DataFrame,
    apply: Callable[[DataFrame, int], DataFrame] | None,
    m: int,
    spare: int = 4,
    steps: int = 8,
    tolerance: float = 1e-7,
    most_rounds: int = 60,
    without_constant: bool = False,
    extend: Callable[[DataFrame, int, int], DataFrame] | None = None,
) -> tuple[DataFrame, list[float]]:
    """The `m` leading vectors of a symmetric operator: id, w, v (array of doubles of length one in the inner product with w); and their values.

    `rows` has id and w, the weight of a row in the inner product. `apply(block, width)` gets
    id, x (array of `width`) and returns id, y, the operator's product; an id it leaves
    out counts as zeros. The operator's spectrum must lie within [-1, 1]. `without_constant`: the
    constant vector is known and taken out. Rounds end when the residual of every wanted vector is at most
    `tolerance`; if they do not, an error is raised. Vectors of equal values are any
    basis of their space. There are fewer where the table is smaller. Signs: the
    sum of a vector with fixed pseudo-random weights is positive. `extend`, if given, takes the place of `apply`: of (rows, width, steps) it
    makes the blocks T0(A) x .. Tsteps+1(A) x at once, as id, w, basis (one array).
    """
    block = m + spare
    start = F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1.0 for i in range(block)])
    cur = materialize(rows.select("id", F.col("w").cast("double").alias("w")).withColumn("x", start), "block")
    n = cur.count()
    if n == 0:
        return cur.select("id", "w", F.col("x").alias("v")), []
    for _ in range(most_rounds):
        if without_constant:
            sums = cur.agg(F.sum("w"), *[F.sum(F.col("w") * F.col("x")[i]) for i in range(block)]).first()
            mean = F.array(*[F.lit(float(s / sums[0])) for s in sums[1:]])
            cur = cur.withColumn("x", F.zip_with("x", mean, lambda a, b: a - b))
        cur = materialize(extend(cur, block, steps), "block") if extend else _basis(cur, apply, block, steps)
        gram = inner_products(cur, block * (steps + 2))
        values, weights, residual = _ritz(gram, block, steps, m)
        basis = cur.select("id", "w", F.slice("basis", 1, block * (steps + 1)).alias("basis"))
        if residual <= tolerance:
            m = min(m, len(values))
            # the sign by one more small sum
            out = materialize(combine(basis, weights[:, :m], "v"), "vectors")
            mark = F.pmod(F.xxhash64("id"), F.lit(1009)) / 1009.0 + 0.1
            sums = out.agg(*[F.sum(F.col("v")[i] * mark) for i in range(m)]).first() if m else []
            sign = F.array(*[F.lit(-1.0 if s < 0 else 1.0) for s in sums]).cast("array<double>")
            return out.withColumn("v", F.zip_with("v", sign, lambda a, b: a * b)), values[:m].tolist()
        if weights.shape[1] < block:  # the table is smaller than the block: the rest stays empty
            weights = np.concatenate([weights, np.zeros((len(weights), block - weights.shape[1]))], axis=1)
        cur = combine(basis, weights, "x")
    raise RuntimeError(f"leading vectors not settled after {most_rounds} rounds; largest residual {residual:.1e}")
