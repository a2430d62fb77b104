"""Sketches, deviations, shifts, doublets and backgrounds against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cellweft.operators import alignment, motifs, network, timing
from cellweft.operators.running import mid_ranks


def test_sketches_find_planted_pairs(spark):
    """Recall over pairs of similar sequences near the threshold and above; every pair given is right, and rows are few."""
    rng = random.Random(4)
    seqs, k = [], 8
    for i in range(150):
        s = rng.choices("ACGT", k=rng.choice([60, 400, 900]))
        t = list(s)
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.randrange(len(t))
            t[at] = rng.choice("ACGT")
        seqs += [(2 * i, "".join(s)), (2 * i + 1, "".join(t))]
    seqs += [(1000, "ACG"), (1001, "ACG"), (1002, ""), (1003, None), (1004, "A" * 500), (1005, "A" * 300)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    exact = {(r.a, r.b): r.jaccard for r in alignment.kmer_similarity(df, k, 0.8).collect()}
    sets = {i: {s[j : j + k] for j in range(len(s) - k + 1)} for i, s in seqs if s and len(s) >= k}
    brute = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    assert exact == pytest.approx(brute) and len(exact) > 100
    few = {(r.a, r.b): r.jaccard for r in alignment.kmer_similarity(df, k, 0.8, sketch=64).collect()}
    assert few.items() <= exact.items()
    assert len(few) >= 0.95 * len(exact)
    assert alignment.kmer_similarity(df.limit(0), k, 0.8, sketch=64).count() == 0


def test_deviation_without_cells_times_draws(spark):
    rng = np.random.default_rng(5)
    m = np.where(rng.random((30, 20)) < 0.4, rng.integers(1, 5, (30, 20)), 0)
    m[:, 19] = 0
    i, j = np.nonzero(m)
    atac = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "cell int, feature int, x double")
    hits = [("p", f) for f in range(5)] + [("q", f) for f in (7, 8)] + [("none", 19)]
    bg = [(x, d, int(f)) for x in ("p", "q", "none") for d in range(6) for f in rng.choice(20, 4, replace=False)]
    got = {(r.cell, r.motif): (r.dev, r.z) for r in motifs.motif_deviation(atac, spark.createDataFrame(hits, "motif string, feature int"), spark.createDataFrame(bg, "motif string, draw int, feature int")).collect()}
    dev = lambda c, fs: m[c, fs].sum() * m.sum() / (m[c].sum() * m[:, fs].sum()) - 1
    for c in set(i.tolist()):
        for x in ("p", "q"):
            own = dev(c, [f for y, f in hits if y == x])
            null = [dev(c, [f for y, e, f in bg if y == x and e == d]) for d in range(6)]
            assert got[c, x][0] == pytest.approx(own)
            assert got[c, x][1] == pytest.approx((own - np.mean(null)) / np.std(null, ddof=1), rel=1e-6)
    assert not any(x == "none" for _, x in got)


@pytest.mark.parametrize("block", [7, 2000])
def test_shifts_by_blocks(spark, block):
    rng = np.random.default_rng(6)
    x = rng.random((60, 3))
    emb = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "cell long, sample int, vec array<double>")
    pairs = [(3 * a, 3 * b + 1) for a in range(12) for b in range(12) if (a * b) % 5 == 1]
    got = {r.cell: r.vec for r in network.mnn_correct(emb, spark.createDataFrame(pairs, "a long, b long"), 0, 0.4, block).collect()}
    for c in range(60):
        want = x[c]
        if c % 3 == 1:
            w = np.array([np.exp(-((x[c] - x[b]) ** 2).sum() / (2 * 0.16)) for _, b in pairs])
            want = x[c] + (w[:, None] * np.array([x[a] - x[b] for a, b in pairs])).sum(axis=0) / w.sum()
        assert got[c] == pytest.approx(want.tolist())


def test_doublets_are_near_the_middle(spark):
    """Two groups: cells between them have simulated doublets around them, cells within do too, but only of their own."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.05, (40, 2)), rng.normal(0, 0.05, (40, 2)) + [4, 0], [[2.0, 0.0], [2.0, 0.1]]])
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, vec array<double>")
    got = {r.cell: r.score for r in network.doublet_score(emb, 1.0, 8).collect()}
    assert set(got) == set(range(82)) and all(0 <= s <= 1 for s in got.values())
    assert min(got[80], got[81]) > np.mean([got[i] for i in range(80)]) + 0.2


def test_centroids_of_samples_meet(spark):
    """Two groups in two samples, the second one shifted: afterwards the samples lie on each other and the groups apart."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, (rng.normal(0, 0.1, 2) + [6 * (i // 2 % 2), 0] + [0, 1.0 * (i % 2)]).tolist()) for i in range(160)]
    out = {r.cell: np.array(r.vec) for r in network.centroid_correct(spark.createDataFrame(rows, "cell long, sample int, vec array<double>"), 2, 3).collect()}
    mean = {(g, s): np.mean([out[i] for i, sample, _ in rows if i // 2 % 2 == g and sample == s], axis=0) for g in (0, 1) for s in (0, 1)}
    for g in (0, 1):
        assert np.abs(mean[g, 0] - mean[g, 1]).max() < 1e-6
    assert np.linalg.norm(mean[0, 0] - mean[1, 0]) == pytest.approx(6, abs=0.1)


def test_backgrounds_match_in_gc_and_width(spark):
    rng = random.Random(9)
    pool = [(i, rng.random(), rng.randrange(50, 3000)) for i in range(800)]
    fg = pool[:40]
    got = motifs.matched_background(spark.createDataFrame(fg, "id long, gc double, length int"), spark.createDataFrame(pool, "id long, gc double, length int"), 3).collect()
    key = lambda gc, n: (int(gc * 10), int(np.log2(n + 1) * 5 / 8))
    want, have = {}, {}
    for i, gc, n in pool:
        have.setdefault(key(gc, n), []).append(i) if i >= 40 else want.__setitem__(key(gc, n), want.get(key(gc, n), 0) + 3)
    drawn = {}
    for r in got:
        assert r.id >= 40
        drawn[key(r.gc, r.length)] = drawn.get(key(r.gc, r.length), 0) + 1
    assert len({r.id for r in got}) == len(got)
    assert drawn == {k: min(n, len(have.get(k, []))) for k, n in want.items() if have.get(k)}


def test_mid_ranks_and_association(spark):
    rows = [("f", b, float(y)) for b, y in enumerate([3, 1, 1, 2, 1, 5, 5])] + [("c", b, 1.0) for b in range(4)] + [("f", 3, None)]
    df = spark.createDataFrame(rows, "feature string, bin int, y double")
    got = {(r.feature, r.y): r.k for r in mid_ranks(df.where("y is not null"), ["feature"], "y", "k").collect()}
    assert got == {("f", 1.0): 2.0, ("f", 2.0): 4.0, ("f", 3.0): 5.0, ("f", 5.0): 6.5, ("c", 1.0): 2.5}
    rho = {r.feature: (r.rho, r.n) for r in timing.time_association(df).collect()}
    assert rho["f"] == (pytest.approx(np.corrcoef([5, 2, 2, 4, 2, 6.5, 6.5], range(7))[0, 1]), 7) and rho["c"] == (None, 4)
    x = [("f", 0, 1.0), ("f", 0, 2.0), ("f", 1, 4.0), ("f", 1, 6.0), ("f", 1, 5.0), ("g", 0, 1.0), ("h", 0, 1.0), ("h", 1, 2.0)]
    f = {r.feature: r.f for r in timing.bin_association(spark.createDataFrame(x, "feature string, bin int, y double")).collect()}
    between, inside = 2 * (1.5 - 3.6) ** 2 + 3 * (5 - 3.6) ** 2, (0.5 + 2.0) / 3
    assert f["f"] == pytest.approx(between / inside) and f["g"] is None and f["h"] is None


def test_copies_are_compared_once(spark, monkeypatch):
    """Three hundred copies of each of four sequences: four are compared, and all pairs come out; before, each copy met each other one."""
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ACGT"), 300))
    kinds = [base, base[:-3] + "AAA", base[:150] + "".join(rng.choice(list("ACGT"), 150)), "ACG"]
    df = spark.createDataFrame([(i, kinds[i % 4]) for i in range(1200)], "id long, seq string")
    compared = []
    real = alignment._jaccard
    monkeypatch.setattr(alignment, "_jaccard", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    sets = [{s[i : i + 12] for i in range(len(s) - 11)} for s in kinds]
    like = lambda x, y: len(sets[x] & sets[y]) / max(len(sets[x] | sets[y]), 1)
    want = {(a, b): like(a % 4, b % 4) for a in range(1200) for b in range(a + 1, 1200) if sets[a % 4] and like(a % 4, b % 4) >= 0.8}
    for sketch in (None, 64):
        got = {(r.a, r.b): r.jaccard for r in alignment.kmer_similarity(df, 12, 0.8, sketch).collect()}
        assert got == want
    assert max(compared) <= 3


def test_few_shared_kmers_are_no_candidates(spark, monkeypatch):
    """Pairs that share a word as rare as what they share with those that are like them are not compared whole."""
    rng, compared = np.random.default_rng(12), []
    some = lambda n: "".join(rng.choice(list("ACGT"), n))
    bases, words = [some(300) for _ in range(60)], [some(16) for _ in range(30)]
    seqs = [s[:100] + w + s[116:] for i, s in enumerate(bases) for w in (words[i // 2], some(16))]
    sets = [{s[i : i + 12] for i in range(len(s) - 11)} for s in seqs]
    assert all(5 <= len(sets[4 * i] & sets[4 * i + 2]) < 10 for i in range(30))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(120) for b in range(a + 1, 120) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    real, write, written = alignment._jaccard, alignment.materialize, []
    monkeypatch.setattr(alignment, "_jaccard", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    monkeypatch.setattr(alignment, "materialize", lambda df, what: (out := write(df, what), written.append(out.count()))[0])
    got = {(r.a, r.b): r.jaccard for r in alignment.kmer_similarity(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), 12, 0.8).collect()}
    assert got == pytest.approx(want) and len(want) == 60
    assert compared == [60]
    assert sum(written) <= 120 + 60 + 60  # sequences and pairs are written, k-mers are not


def test_shifts_far_from_the_origin_and_a_task_for_each_pair_of_blocks(spark):
    rng = np.random.default_rng(13)
    x = rng.random((60, 3)) + 1e6
    emb = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "cell long, sample int, vec array<double>")
    pairs = [(3 * a, 3 * b + 1) for a in range(12) for b in range(12) if (a * b) % 5 == 1]
    out = network.mnn_correct(emb, spark.createDataFrame(pairs, "a long, b long"), 0, 0.4, 7)
    got = {r.cell: r.vec for r in out.collect()}
    at, diff = np.array([x[b] for _, b in pairs]), np.array([x[a] - x[b] for a, b in pairs])
    for i in range(60):
        w = np.exp(-((at - x[i]) ** 2).sum(axis=1) / (2 * 0.4**2))
        assert got[i] == pytest.approx(x[i] + (w @ diff / w.sum() if i % 3 == 1 else 0), rel=1e-12)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
