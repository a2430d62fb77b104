"""Intervals over several bins of their own level: the same pairs, and few that meet in vain."""

from __future__ import annotations

import random

import pytest

from cellweft.operators import intervals as IV
from tests.test_sweep import some


@pytest.mark.parametrize("most", [20_000, 20])
@pytest.mark.parametrize("spans", [1, 4, 7])
def test_pairs_come_once(spark, spans, most):
    rng = random.Random(spans)
    a, b = some(rng, 200, lambda i: i), some(rng, 200, lambda i: i)
    left, right = (spark.createDataFrame(x, "id long, chrom string, st long, en long") for x in (a, b))
    got = sorted((r.id, r.b_id) for r in IV.interval_join(left, right, 50, most, spans).collect())
    want = sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c and c == d and s < f and t < e and s < e and t < f)
    assert got == want


def test_peaks_and_genes_that_meet_are_about_the_pairs(spark, monkeypatch):
    """At most 1.5 times as many meet as there are pairs; 5 times before."""
    peaks = spark.range(3000).selectExpr("id pid", "'x' chrom", "id * 97 st", "id * 97 + 200 en")
    tss = spark.range(60).selectExpr("id gene", "'x' chrom", "30000 + id * 3001 tss", "'+' strand")
    met, cut = [], IV.binned

    def seen(*args):
        left, right = cut(*args)
        met.append(left.join(right, ["chrom", "_level", "_bin", "_s", "_t"]).count())
        return left, right

    monkeypatch.setattr(IV, "binned", seen)
    pairs = IV.peak_gene_pairs(peaks, tss, 10000).count()
    want = sum(abs(p * 97 + 100 - (30000 + g * 3001)) <= 10000 for p in range(3000) for g in range(60))
    assert pairs == want and met[0] <= 1.5 * pairs


@pytest.mark.parametrize("longest", [50, 30_000])
def test_tasks_are_dealt_by_the_pairs_that_meet(spark, monkeypatch, longest):
    """With bins of one level and of several; before, Spark dealt by bytes, as few tasks as it had shuffle partitions."""
    a = spark.range(2000).selectExpr("id", "'x' chrom", "id * 50 st", f"id * 50 + if(id = 7, {longest}, 50) en")
    left, right = IV.binned(a, a, 2000, 100)
    met = left.join(right, ["chrom", "_level", "_bin", "_s", "_t"]).count()
    n = 3 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(IV, "MEET", -(-met // n), raising=False)
    pairs = IV.interval_join(a, a, 2000, 100)
    assert pairs.rdd.getNumPartitions() in (n, n - 1)
    assert pairs.count() == 2000 + (2 * (longest // 50 - 1))


def test_a_pair_computes_no_bin(spark):
    """What a row has alone (its level, whether it starts in the bin) is no work of each pair that meets; before, powers and floors were."""
    a = spark.range(2000).selectExpr("id", "'x' chrom", "id * 50 st", "id * 50 + 50 en")
    plan = IV.interval_join(a, a, 2000, 100)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert joins and not [x for x in joins if "POWER" in x or "FLOOR" in x]
