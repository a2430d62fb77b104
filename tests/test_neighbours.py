"""Approximate neighbours: recall against exact ones, bounded meetings, odd tables."""

from __future__ import annotations

import numpy as np
import pytest

from cellweft.operators import neighbours, network
from cellweft.plans.views import view

VEC = "cell long, vec array<double>"


def recall(spark, emb, k=10, **options):
    got = neighbours.knn_descent(emb, k, **options).collect()
    want = {(r.a, r.b): r.distance for r in network.knn(emb, k).collect()}
    assert all(abs(r.distance - want[r.a, r.b]) < 1e-9 for r in got if (r.a, r.b) in want)
    return sum((r.a, r.b) in want for r in got) / len(want)


def test_recall_on_the_given_table(spark, sf_dir):
    assert recall(spark, view(spark, sf_dir, "m_emb")) >= 0.95


def test_recall_on_points_without_groups(spark):
    """Where the first graph is poor: 1,500 uniform points of eight dimensions, short runs, one direction."""
    x = np.random.default_rng(1).random((1500, 8))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(4)
    assert recall(spark, emb, tables=1, block=40) >= 0.95  # the first graph alone has some 0.1


def test_meetings_are_bounded(spark):
    """One cell is a neighbour of all others, yet few meet at it."""
    rows = [(i, 0, 1.0, True) for i in range(1, 4000)] + [(i, i % 3999 + 1, 2.0, True) for i in range(1, 4000)] + [(0, 1, 1.0, True)]
    graph = spark.createDataFrame([r for r in rows if r[0] != r[1]], "a long, b long, distance double, fresh boolean")
    most = neighbours.meetings(graph, 20, 0).groupBy("at").count().agg({"count": "max"}).first()[0]
    assert most <= 60


def test_equal_cells_and_small_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)] + [(1000 + i, [5.0, float(i)]) for i in range(5)], VEC)
    got = neighbours.knn_descent(same, 3).collect()
    assert {r.a for r in got} == {*range(600), *range(1000, 1005)}
    assert all(r.distance == 0 for r in got if r.a < 600) and all(r.a != r.b for r in got)
    one = spark.createDataFrame([(1, [1.0]), (2, [3.0])], VEC)
    assert sorted((r.a, r.b, r.distance, r.rank) for r in neighbours.knn_descent(one, 5).collect()) == [(1, 2, 2.0, 1), (2, 1, 2.0, 1)]
    assert neighbours.knn_descent(one.limit(0), 5).count() == 0


def test_unsettled_is_an_error(spark):
    x = np.random.default_rng(2).random((400, 8))
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    with pytest.raises(RuntimeError, match="not settled"):
        neighbours.knn_descent(emb, 10, tables=1, block=20, most_rounds=1)


def test_a_cell_is_shuffled_a_bounded_number_of_times(spark):
    """Blocks grow with the table up to their bound; before, there was one per 2,000 rows."""
    assert [network._parts(spark.range(n), 12, 100_000) for n in (0, 1, 2001, 6_000, 60_000, 1_000_000, 1_300_000)] == [1, 1, 5, 12, 12, 12, 13]


def test_exact_neighbours_over_blocks(spark):
    x = np.random.default_rng(5).integers(0, 4, (900, 3)).astype(float)  # many equal distances
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    want = {(i, int(j)): r + 1 for i in range(900) for r, j in enumerate(np.lexsort((np.arange(900), far[i]))[:7])}
    assert {(r.a, r.b): r["rank"] for r in network.knn(emb, 7, parts=3, block=200).collect()} == want


def test_singles_stay_singles_until_they_meet(spark, monkeypatch):
    """Vectors of singles are written and shuffled as such, and distances are those of doubles."""
    kinds = {}
    real = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, what: kinds.update({what: dict(df.dtypes)}) or real(df, what))
    x = np.random.default_rng(6).random((300, 4)).astype(np.float32)
    got = neighbours.knn_descent(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, vec array<float>"), 5).collect()
    assert kinds["vectors"]["vec"] == "array<float>"
    assert all(abs(r.distance - np.sqrt(((x[r.a].astype(float) - x[r.b]) ** 2).sum())) < 1e-12 for r in got)
