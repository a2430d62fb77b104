"""Running sums, links and their background, labels and ranks against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import cells, network
from cellweft.operators.running import running, running_totals


def test_running_totals_of_a_group_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.9 else f"g{rng.randrange(30)}", i, rng.randrange(5)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    got = running_totals(df, ["g"], ["i"], "v", "before")
    assert spark.createDataFrame(rows, "g string, i int, v int").count() == got.count()
    so_far = defaultdict(int)
    want = {}
    for g, i, v in sorted(rows):
        want[g, i] = so_far[g]
        so_far[g] += v
    assert {(r.g, r.i): r.before for r in got.collect()} == want
    assert running_totals(df.limit(0), ["g"], ["i"], "v", "before").count() == 0


def test_running_minimum_from_the_end(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaab"), i, rng.random()) for i in range(500)]
    got = running(spark.createDataFrame(rows, "g string, i int, v double").repartition(3), ["g"], ["i"], "v", "low", F.min, after=True, own=True)
    want = {(g, i): min(v for h, j, v in rows if h == g and j >= i) for g, i, _ in rows}
    assert {(r.g, r.i): r.low for r in got.collect()} == want


def sides(rng, n=60, fx=12, fy=15):
    return (np.where(rng.random((n, fx)) < 0.3, rng.integers(1, 9, (n, fx)), 0), np.where(rng.random((n, fy)) < 0.4, rng.integers(1, 9, (n, fy)), 0))


def long(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(b), int(a), float(m[a, b])) for a, b in zip(i, j, strict=True)], "feature int, cell int, x double")


def test_links_at_listed_pairs(spark):
    """Values are numpy's either way; for few pairs the rows made are pairs times cells of the sparser side."""
    x, y = sides(np.random.default_rng(3))
    dx, dy = long(spark, x), long(spark, y)
    n = spark.createDataFrame([(60,)], "n long")
    for pairs in ([(0, 0), (3, 7), (5, 2), (11, 14)], [(i, j) for i in range(12) for j in range(15)]):
        got = {(r.fx, r.fy): r.corr for r in network.link_corr(dx, dy, spark.createDataFrame(pairs, "fx int, fy int"), n).collect()}
        assert got == pytest.approx({(i, j): np.corrcoef(x[:, i], y[:, j])[0, 1] for i, j in pairs})
    few = [(0, 0), (3, 7)]
    made = network.link_products(dx, dy, spark.createDataFrame(few, "fx int, fy int"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in plan
    assert {(r.fx, r.fy): r._sxy for r in made.collect()} == {(i, j): float((x[:, i] * y[:, j]).sum()) for i, j in few}
    # the join on cells alone would make this many rows, the pairs' sparser sides hold fewer
    assert sum(min((x[:, i] > 0).sum(), (y[:, j] > 0).sum()) for i, j in few) < ((x > 0).sum(axis=1) * (y > 0).sum(axis=1)).sum() / 10


@pytest.mark.parametrize("draws", [3, 20, 500])
def test_background_is_drawn_once_and_without_the_link(spark, draws):
    rng = random.Random(draws)
    links = [(fx, fy, round(rng.random(), 2)) for fx in range(30) for fy in range(9)] + [(2, 100, None)]
    stats = [(fx, rng.random(), rng.random()) for fx in range(30)]
    got = network.null_corr(spark.createDataFrame(links, "fx int, fy int, corr double"), spark.createDataFrame(stats, "feature int, mean double, gc double"), draws, strata=2, block=7)
    by_mean, by_gc = [{f: 2 * i // 30 for i, (_, f) in enumerate(sorted((s[k], s[0]) for s in stats))} for k in (1, 2)]
    groups = defaultdict(list)
    for fx, fy, corr in links:
        if corr is not None:
            groups[by_mean[fx], by_gc[fx]].append((hashlib.md5(f"{fx}:{fy}".encode()).hexdigest(), fx, fy, corr))
    want = {}
    for rows in groups.values():
        rows.sort()
        m = min(draws, len(rows) - 1)
        for i, (_, fx, fy, corr) in enumerate(rows):
            drawn = [rows[(i + j) % len(rows)] for j in range(1, m + 1)]
            assert len({d[1:3] for d in drawn} - {(fx, fy)}) == m
            want[fx, fy] = ((1 + sum(d[3] >= corr for d in drawn)) / (1 + m), m)
    assert {(r.fx, r.fy): (r.p, r.drawn) for r in got.collect()} == want


def test_labels_settle_where_none_would_change(spark):
    rng = random.Random(5)
    edges = {tuple(sorted((rng.choice(g), rng.choice(g)))) for g in (range(0, 20), range(20, 45), range(45, 60)) for _ in range(120)} | {(0, 21), (22, 46)}
    edges = [e for e in edges if e[0] != e[1]] + [(70 + i, 70 + (i + 1) % 6) for i in range(6)]  # an even ring swaps for ever if all change at once
    got = {r.cell: r.label for r in network.label_propagation(spark.createDataFrame([(*e, 1.0) for e in edges], "a long, b long, distance double")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    assert set(got) == set(near)
    for c, around in near.items():
        votes = Counter(got[x] for x in (*around, c))
        assert votes[got[c]] == max(votes.values())
    # plain rounds with the same rule end in the same labels
    cur = {c: c for c in near}
    for turn in range(1000):
        half = {r.c: r.h for r in spark.createDataFrame([(c,) for c in near], "c long").select("c", F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(2)).alias("h")).collect()}
        nxt, wants = {}, False
        for c, around in near.items():
            votes = Counter(cur[x] for x in (*around, c))
            best = min(votes, key=lambda v: (-votes[v], v))
            want = votes[best] > votes[cur[c]]
            wants |= want
            nxt[c] = best if want and half[c] == 0 else cur[c]
        if not wants:
            break
        cur = nxt
    assert got == cur


def test_pagerank_is_numpy_s(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(40), rng.randrange(50)) for _ in range(150)}
    got = {r.node: r.rank for r in network.pagerank(spark.createDataFrame(list(edges) * 2, "src long, dst long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    out = Counter(a for a, _ in edges)
    move = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        move[nodes.index(b), nodes.index(a)] = 1 / out[a]
    move[:, [i for i, v in enumerate(nodes) if not out[v]]] = 1 / len(nodes)
    google = 0.85 * move + 0.15 / len(nodes)
    values, vectors = np.linalg.eig(google)
    want = np.real(vectors[:, np.argmax(np.real(values))])
    assert [got[v] for v in nodes] == pytest.approx((want / want.sum()).tolist(), abs=1e-9)
    with pytest.raises(RuntimeError, match="not settled"):
        network.pagerank(spark.createDataFrame(list(edges), "src long, dst long"), most_rounds=2)


def test_mid_ranks_of_ties(spark):
    x = [(1, "f", 2.0), (2, "f", 2.0), (3, "f", 1.0), (4, "f", 3.0), (5, "f", 2.0)]
    groups = [(c, "a" if c in (1, 4) else "b") for c in range(1, 8)]
    got = {r.grp: r.z for r in cells.rank_markers(spark.createDataFrame(x, "cell long, feature string, x double"), spark.createDataFrame(groups, "cell long, grp string"), 3).collect()}
    # values 0 0 1 2 2 2 3: mid-ranks 1.5 1.5 3 5 5 5 7; group a has 5 and 7
    n, m, ties = 7, 2, (8 - 2) + (27 - 3)
    var = m * (n - m) / 12 * ((n + 1) - ties / (n * (n - 1)))
    assert got["a"] == pytest.approx((12 - m * (n + 1) / 2) / var**0.5, abs=1e-6)
    assert got["b"] == pytest.approx(-got["a"], abs=1e-6)
