"""Diffusion time and truncated singular values against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from cellweft.operators import reduce, spectral, timing
from cellweft.plans import views
from cellweft.plans.registry import QUERIES
from cellweft.plans.time_queries import _knn

EDGES = "a long, b long, distance double"


def walk_vectors(edges, m):
    nodes = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(nodes)}
    adj = np.zeros((len(nodes), len(nodes)))
    for a, b in {tuple(sorted(e[:2])) for e in edges if e[0] != e[1]}:
        adj[at[a], at[b]] = adj[at[b], at[a]] = 1
    d = adj.sum(axis=1)
    values, vectors = np.linalg.eigh(adj / np.sqrt(d[:, None] * d[None, :]))
    order = np.argsort(-values)
    return nodes, values[order], (vectors / np.sqrt(d)[:, None])[:, order[1 : m + 1]]


def test_diffusion_is_numpy_s(spark, sf_dir):
    """On the neighbour graph of the query, where leading values are close to each other."""
    edges = [(r.a, r.b) for r in _knn(spark, sf_dir).select("a", "b").collect()]
    nodes, values, v = walk_vectors(edges, 2)
    assert values[2] - values[3] < 0.05  # a narrow gap
    want = np.sqrt(((v - v[nodes.index(0)]) ** 2).sum(axis=1))
    got = {r.cell: r.t for r in QUERIES["t2_diffusion"](spark, sf_dir).collect()}
    assert np.array([got[x] for x in nodes]) == pytest.approx(want, abs=2e-6)


def test_diffusion_small_graphs(spark):
    two = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 10) for b in range(a + 1, s + 10)] + [(9, 10, 1.0), (10, 9, 1.0), (3, 3, 1.0)]
    nodes, _, v = walk_vectors(two, 1)
    got = {r.cell: r.t for r in timing.pseudotime_diffusion(spark.createDataFrame(two, EDGES), 0, m=1).collect()}
    assert [got[x] for x in nodes] == pytest.approx(np.abs(v[:, 0] - v[0, 0]), abs=1e-6)
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], EDGES)
    assert timing.pseudotime_diffusion(path, 0, m=2).count() == 3
    assert timing.pseudotime_diffusion(path.limit(0), 0).count() == 0


def test_unsettled_vectors_are_an_error(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 400, 1.0) for i in range(400)], EDGES)
    both = ring.select("a", "b").union(ring.select("b", "a")).toDF("a", "b")
    rows = both.groupBy("a").count().toDF("id", "w")

    def walk(block, width):
        return both.join(block.withColumnRenamed("id", "b"), "b").groupBy(both["a"].alias("id")).agg(spectral.block_sum("x", width).alias("y"))

    with pytest.raises(RuntimeError, match="not settled"):
        spectral.leading_vectors(rows, lambda b, w: walk(b, w), 2, steps=2, most_rounds=1, tolerance=1e-12)


def sparse(rng, n, f, share):
    m = np.where(rng.random((n, f)) < share, rng.random((n, f)), 0.0)
    m[:, : f // 4] *= 3
    return m


def long(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), f"f{b:05}", float(m[a, b])) for a, b in zip(i, j, strict=True)], "cell long, feature string, x double")


def test_lsi_is_numpy_s(spark):
    m = sparse(np.random.default_rng(6), 60, 150, 0.3)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    scores, loads, values = reduce.lsi(long(spark, m), 3)
    assert values == pytest.approx(s[:3].tolist(), rel=1e-7)
    got = np.array([r.vec for r in scores.orderBy("cell").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-5)
    v = np.array([r.vec for r in loads.orderBy("feature").collect()])
    assert np.abs(v) == pytest.approx(np.abs(vt[:3].T), abs=1e-5)
    few = reduce.lsi(long(spark, m), 2, spark.createDataFrame([("f00001",), ("f00007",)], "feature string"))
    assert few[2] == pytest.approx(np.linalg.svd(m[:, [1, 7]])[1].tolist(), rel=1e-7)


def test_lsi_of_more_features_than_a_square_table_allows(spark):
    """10**5 features; a table of rank 3, so that numpy can tell the values from small factors."""
    rng = np.random.default_rng(8)
    cells, f = 40, 100_000
    left = np.linalg.qr(rng.normal(size=(cells, 3)))[0]
    pick = np.arange(f) % 3
    size = rng.random(f) + 0.1
    want = [np.sqrt((size[pick == c] ** 2).sum()) for c in range(3)]
    from pyspark.sql import functions as F

    sizes = spark.createDataFrame([(int(i), float(size[i]), left[:, pick[i]].tolist()) for i in range(f)], "feature long, s double, col array<double>")
    x = sizes.select("feature", "s", F.posexplode("col").alias("cell", "c")).select("cell", "feature", (F.col("s") * F.col("c")).alias("x"))
    scores, loads, values = reduce.lsi(x, 4)
    assert values == pytest.approx(sorted(want, reverse=True), rel=1e-6)  # the fourth value is none
    assert loads.count() == f and len(scores.first().vec) == 3


def test_lsi_of_nothing(spark):
    x = spark.createDataFrame([], "cell long, feature string, x double")
    scores, loads, values = reduce.lsi(x, 3)
    assert (scores.count(), loads.count(), values) == (0, 0, [])
