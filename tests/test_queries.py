"""Every query over the stand-in views against its SQL, and hand-made cases."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest

from cellweft.operators import alignment, cells, intervals, motifs, network, reduce, timing
from cellweft.plans.registry import QUERIES, SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"t2_diffusion", "g11_pagerank"}))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


IV = "pid long, chrom string, st long, en long"


def test_half_open_and_many_bins(spark):
    a = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 0, 20000)], IV)
    b = spark.createDataFrame([(1, "c", 10, 20), (2, "c", 5, 19000)], IV)
    got = sorted((r.pid, r.b_pid) for r in intervals.interval_join(a, b).collect())
    assert got == [(1, 2), (2, 1), (2, 2)]
    assert intervals.interval_join(a.limit(0), b).count() == 0


def test_intervals_of_all_lengths(spark):
    """Against all pairs; lengths from one base to a chromosome, on either side, and bins with so many rows that they are split."""
    rng = np.random.default_rng(9)

    def some(n, first):
        size = np.minimum(10 ** rng.uniform(0, 6.5, n), 3_000_000).astype(int)
        st = np.where(rng.random(n) < 0.5, rng.integers(0, 3_000_000, n), rng.integers(0, 3000, n))
        return [(first + i, "c" if i % 5 else "d", int(s), int(s + w)) for i, (s, w) in enumerate(zip(st, size, strict=True))] + [(first + n, "c", 5, 5)]

    a, b = some(150, 0), some(120, 1000)
    want = sorted((p, q) for p, c, s, e in a for q, d, t, f in b if c == d and s < f and t < e and e > s and f > t)
    for most in (20_000, 6):
        got = intervals.interval_join(spark.createDataFrame(a, IV), spark.createDataFrame(b, IV), most=most)
        assert got.columns == ["pid", "chrom", "st", "en", "b_pid", "b_st", "b_en"]
        assert sorted((r.pid, r.b_pid) for r in got.collect()) == want


def test_a_long_interval_is_few_rows(spark):
    a = spark.createDataFrame([(1, "c", 0, 250_000_000)], IV)
    b = spark.createDataFrame([(i, "c", i * 1000, i * 1000 + 500) for i in range(3000)], IV)
    left, right = intervals.binned(a, b, 2000)
    assert left.count() <= 2 and right.count() <= 4 * 3000
    assert intervals.interval_join(a, b).count() == 3000
    # a hot bin: no part of it has more rows of a side than asked for
    left, right = intervals.binned(b, b, 100_000_000, most=500)
    keys = ["chrom", "_level", "_bin", "_s", "_t"]
    assert max(x.groupBy(*keys).count().agg({"count": "max"}).first()[0] for x in (left, right)) < 650


def test_kernel_trend(spark):
    """Against the sum over all pairs of bins, on a cycle and on a line; nulls and features without rows are passed over."""
    rng = np.random.default_rng(10)
    t, y = rng.random(200) * 10, rng.random(200)
    rows = [("f", float(a), float(b)) for a, b in zip(t, y, strict=True)] + [("f", None, 1.0), ("f", 1.0, None)]
    x = spark.createDataFrame(rows, "feature string, t double, y double")
    for period in (10.0, None):
        low, span = (0.0, 10.0) if period else (t.min(), t.max() - t.min())
        at = np.clip(np.floor((t - low) * 20 / span), 0, 19)
        gap = np.abs(at[:, None] - np.arange(20)[None, :])
        gap = np.minimum(gap, 20 - gap) if period else gap
        w = np.exp(-((gap * span / 20) ** 2) / (2 * 0.8**2))
        want = (w * y[:, None]).sum(axis=0) / w.sum(axis=0)
        got = timing.kernel_trend(x, 20, 0.8, period).orderBy("bin").collect()
        assert [r.y for r in got] == pytest.approx(want.tolist())
        assert got[0]["t"] == pytest.approx(low + span / 40)


def test_implicit_zeros(spark):
    c = spark.createDataFrame([("s", i, "f", x) for i, x in ((1, 2.0), (2, 4.0))] + [("s", i, "g", 1.0) for i in (1, 2, 3, 4)], "sample string, cell long, feature string, x double")
    m = {r.feature: (r.mean, r.var) for r in cells.feature_moments(c).collect()}
    assert m["f"] == (1.5, pytest.approx(np.var([2, 4, 0, 0], ddof=1)))
    assert m["g"] == (1.0, 0.0)


def test_lift_cases(spark):
    blocks = spark.createDataFrame([("c", 0, 100, "d", 500, 600, "+", 1), ("c", 120, 200, "d", 620, 700, "+", 1), ("c", 300, 400, "d", 1000, 1100, "-", 2)], "src_chrom string, src_start long, src_end long, dst_chrom string, dst_start long, dst_end long, dst_strand string, chain long")
    iv = spark.createDataFrame([(1, "c", 10, 30), (2, "c", 90, 130), (3, "c", 310, 320), (4, "c", 210, 260)], "id long, chrom string, st long, en long")
    got = {r.id: (r.dst_st, r.dst_en, r.dst_strand, r.frac) for r in alignment.lift(iv, blocks).collect()}
    assert got == {1: (510, 530, "+", 1.0), 2: (590, 630, "+", 0.5), 3: (1080, 1090, "-", 1.0)}
    kinds = {r.id: r.kind for r in alignment.lift_filter(iv, alignment.lift(iv, blocks), 0.9).collect()}
    assert kinds == {1: "mapped", 2: "partial", 3: "mapped", 4: "deleted"}
    home = alignment.reciprocal(iv, blocks, alignment.invert(blocks))
    assert {r.id for r in home.collect()} == {1, 3}


def test_gapped_alignment(spark):
    rows = spark.createDataFrame([(1, "r", "AC-GT"), (1, "x", "ACCGA")], "block long, species string, text string")
    r = alignment.align_identity(rows, "r").first()
    assert (r.n, r.gaps, r.identity) == (5, 1, 0.75)
    pos = {x.col: x.pos for x in alignment.project_positions(rows, "r").collect()}
    assert pos == {0: 0, 1: 1, 2: None, 3: 2, 4: 3}


def test_hypergeometric(spark):
    from pyspark.sql import functions as F

    p = spark.range(1).select(motifs.hypergeometric_tail(*map(F.lit, (1000, 120, 80, 20))).alias("p")).first().p
    want = sum(math.comb(120, i) * math.comb(880, 80 - i) for i in range(20, 81)) / math.comb(1000, 80)
    assert p == pytest.approx(want, rel=1e-8)


def test_motif_edges(spark):
    pwm = spark.createDataFrame([("m", i, b, 1.0 if b == w else -1.0) for i, w in enumerate("ACG") for b in "ACGT"], "motif string, pos int, base string, w double")
    seqs = spark.createDataFrame([(1, "AC"), (2, "ANGACG"), (3, "CGT"), (4, "")], "id long, seq string")
    got = sorted((r.id, r.start, r.strand) for r in motifs.motif_scan(seqs, pwm, 3.0).collect())
    assert got == [(2, 3, "+"), (3, 0, "-")]


def test_circular_mean(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 2 * math.pi - 0.1)], "g string, phase double")
    m = timing.circular_mean(df, "g").first()["mean"]
    assert min(m, 2 * math.pi - m) < 1e-9


def test_geodesic_is_dijkstra(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 120), rng.integers(0, 60, 120), rng.random(120), strict=True)]
    got = {r.cell: r.t for r in timing.pseudotime_geodesic(spark.createDataFrame(edges, "a long, b long, distance double"), spark.createDataFrame([(0,)], "cell long")).collect()}
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    want, todo = {}, [(0.0, 0)]
    while todo:
        t, a = heapq.heappop(todo)
        if a not in want:
            want[a] = t
            for b, w in near.get(a, []):
                heapq.heappush(todo, (t + w, b))
    assert got == pytest.approx(want)


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (1, 5)], "src long, dst long")
    got = {r.node: r.rank for r in network.pagerank(e, rounds=12).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert max(got, key=got.get) == 1


def test_ridge_values(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 2)), rng.random(40)
    rows = [("t", i, f"r{j}", float(x[i, j]), float(y[i])) for i in range(40) for j in range(2)]
    got = {r.regulator: r.weight for r in network.grn_ridge(spark.createDataFrame(rows, "target string, obs long, regulator string, x double, y double"), 0.5).collect()}
    m = x - x.mean(axis=0)
    want = np.linalg.solve(m.T @ m + 0.5 * np.eye(2), m.T @ (y - y.mean()))
    assert [got["r0"], got["r1"]] == pytest.approx(want.tolist())


def test_mad_and_ties(spark):
    df = spark.createDataFrame([("s", float(x)) for x in (1, 2, 2, 3, 100)], "sample string, v double")
    assert cells.filter_mad(df, "v", 3, "sample").count() == 4
    p = spark.createDataFrame([("g", i, x) for i, x in enumerate((0.01, 0.01, 0.5))], "grp string, id long, p double")
    assert [round(r.q, 6) for r in network.bh_adjust(p, "grp").orderBy("id").collect()] == [0.015, 0.015, 0.5]


def test_reduced_spaces(spark):
    rng = np.random.default_rng(6)
    m = np.where(rng.random((40, 6)) < 0.5, rng.random((40, 6)), 0.0)
    rows = [(i, f"f{j}", float(m[i, j])) for i in range(40) for j in range(6) if m[i, j] > 0]
    x = spark.createDataFrame(rows, "cell long, feature string, x double")
    f = x.select("feature").distinct()
    keep = sorted({r[0] for r in rows})
    pc = np.array([r.vec for r in reduce.pca(x, f, 2).orderBy("cell").collect()])
    want = np.linalg.svd(m[keep] - m[keep].mean(axis=0), full_matrices=False)[2][:2]
    assert np.abs(pc) == pytest.approx(np.abs(m[keep] @ want.T), abs=1e-8)
