"""The walk's products by pieces against numpy; exact neighbours with repeated ids and equal vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import network, spectral, timing
from cellweft.operators.walk import walk_basis


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("piece", [4, 5000])
def test_blocks_are_the_chebyshev_blocks(spark, kind, piece):
    rng = np.random.default_rng(piece)
    n, width, steps = 60, 3, 4
    adj = np.triu(rng.random((n, n)) < 0.06, 1)
    adj[0, 1:] = True  # a hub
    adj = (adj | adj.T).astype(float)
    name = (lambda i: int(i)) if kind == "long" else (lambda i: f"n{i:03}")
    edges = spark.createDataFrame([(name(i), name(j)) for i, j in zip(*np.nonzero(adj), strict=True)], f"a {kind}, b {kind}")
    nodes = edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("w"))
    x = rng.normal(size=(n, width))
    rows = spark.createDataFrame([(name(i), float(adj[i].sum()), x[i].tolist()) for i in range(n)], f"id {kind}, w double, x array<double>")
    got = walk_basis(edges, nodes, piece, most=12)(rows, width, steps)
    got = {r.id: (r.w, r.basis) for r in got.collect()}
    walk = adj / adj.sum(axis=1)[:, None]
    want = [x, walk @ x]
    for _ in range(steps):
        want.append(2 * walk @ want[-1] - want[-2])
    want = np.concatenate(want, axis=1)
    assert len(got) == n
    for i in range(n):
        assert got[name(i)][0] == adj[i].sum()
        assert got[name(i)][1] == pytest.approx(want[i].tolist(), abs=1e-12)


def test_products_of_a_round_are_one_job(spark, monkeypatch):
    """A table per round, not one per product (nine of them before)."""
    written = []
    write = spectral.materialize
    monkeypatch.setattr(spectral, "materialize", lambda df, what: written.append(what) or write(df, what))
    two = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 10) for b in range(a + 1, s + 10)] + [(9, 10, 1.0)]
    timing.pseudotime_diffusion(spark.createDataFrame(two, "a long, b long, distance double"), 0, m=1).collect()
    assert len(written) <= 4


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block", [50, 100_000])
def test_exact_neighbours(spark, kind, block):
    rng = np.random.default_rng(block)
    ids = [*range(700), 5, 5, 6]  # ids that come up again are no neighbours of themselves
    x = rng.integers(0, 4, size=(len(ids), 4)).astype(float)  # many equal distances
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], f"cell long, vec array<{kind}>")
    own = emb.where("cell > 6") if block == 100_000 else emb.dropDuplicates(["cell"])
    rows = own.orderBy("cell").collect()
    cells, v = np.array([r.cell for r in rows]), np.array([r.vec for r in rows])
    edges = network.knn(own, 5, block=block)
    got = {(r.a, r["rank"]): (r.b, r.distance) for r in edges.collect()}
    for i, a in enumerate(cells):
        far = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((cells, far)) if j != i][:5]
        assert [got[(a, k + 1)] for k in range(5)] == [(cells[j], far[j]) for j in order]
    again = network.knn(emb, 5, block=block).collect()
    assert not [r for r in again if r.a == r.b]
