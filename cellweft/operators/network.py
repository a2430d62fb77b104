"""Neighbours, samples and gene regulatory networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.running import running, running_totals
from cellweft.operators.spectral import block_sum
from cellweft.operators.tables import dealt, materialize


def _distance2(a: str, b: str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _parts(df: DataFrame, parts: int, block: int) -> int:
    """Blocks of a side: `parts` of any size, more only where they would hold over `block` rows; one for a small table."""
    n = df.count()
    return max(1, min(parts, -(-n // 500)), -(-n // block))


def knn(emb: DataFrame, k: int, queries: DataFrame | None = None, parts: int = 12, block: int = 100_000) -> DataFrame:
    """The k nearest cells of each cell by Euclidean distance: a, b, distance, rank; ties by cell.

    Exact: every query meets every row. Both sides are dealt to `parts` blocks, whatever the table's size (more
    only where a block would hold over `block` rows), and a task holds one pair of blocks. So a
    row is shuffled `parts` times, and a query has `parts` lists of k candidates, the best
    of which follow by a window; only the distances, which are no rows, grow with the square of the cells. They are
    made for some queries at a time. Vectors must be of one length.
    """
    # vectors of floats are shuffled as they are, and doubles in the task
    typed = lambda df: df.select(F.col("cell").cast("long").alias("cell"), F.col("vec").cast("array<float>" if df.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>").alias("vec"))
    own = typed(emb)
    ask = own if queries is None else typed(queries)
    nq, nr = _parts(ask, parts, block), _parts(own, parts, block)
    part = lambda m: F.pmod(F.xxhash64("cell"), F.lit(m)).cast("int")
    ask = ask.withColumns({"_q": part(nq), "_r": F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))})
    own = own.withColumns({"_r": part(nr), "_q": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "distance": []})
        if not len(left) or not len(right):
            return none
        x, y = np.stack(left["vec"].to_numpy()).astype(float), np.stack(right["vec"].to_numpy()).astype(float)
        a, b = left["cell"].to_numpy(), right["cell"].to_numpy()
        order = np.argsort(b, kind="stable")
        y, b = y[order], b[order]
        xx, yy, turned = (x * x).sum(axis=1), (y * y).sum(axis=1), np.ascontiguousarray(-2 * y.T)
        own, end = np.searchsorted(b, a), np.searchsorted(b, a, "right")
        m, some, found = min(k, len(b)), max(1, 1_000_000 // len(b)), []
        runs = min(20 * m, len(b))  # the m-th least of their least distances bounds the m-th least of all
        for at in range(0, len(a), some):
            here = slice(at, at + some)
            near = x[here] @ turned
            near += yy
            near += xx[here, None]
            for step in range((end[here] - own[here]).max()):
                same = np.flatnonzero(own[here] + step < end[here])
                near[same, own[here][same] + step] = np.inf
            least = near[:, : len(b) // runs * runs].reshape(len(near), -1, runs).min(axis=1)
            limit = np.partition(least, m - 1, axis=1)[:, m - 1]
            i, j = np.divmod(np.flatnonzero(near <= (limit + 1e-9 * (1 + np.abs(limit)))[:, None]), len(b))
            keep = np.isfinite(near[i, j])
            i, j = i[keep], j[keep]
            far = np.sqrt(((x[here][i] - y[j]) ** 2).sum(axis=1))
            # of cells at one distance the first k will do, as ties go by cell
            order = np.lexsort((b[j], far, i))
            i, j, far = i[order], j[order], far[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, far = i[rank < k], j[rank < k], far[rank < k]
            found.append(pd.DataFrame({"a": a[here][i], "b": b[j], "distance": far}))
        return pd.concat(found)

    keys = ["_q", "_r"]
    ask, own = ask.repartition(nq * nr, *keys), own.repartition(nq * nr, *keys)  # else Spark merges the pairs to as few tasks as the cores
    pairs = ask.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(best, "a long, b long, distance double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= k)


def mnn_pairs(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of cells of different samples that are each among the other's neighbours, a < b."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select("a", "b").join(back, ["a", "b"]).where("a < b")
    s = cells.select("cell", "sample")
    both = both.join(s.withColumnsRenamed({"cell": "a", "sample": "_sa"}), "a").join(s.withColumnsRenamed({"cell": "b", "sample": "_sb"}), "b")
    return both.where("_sa <> _sb").select("a", "b")


def mixing_score(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Entropy and inverse Simpson index of the samples among each cell's neighbours."""
    s = cells.select(F.col("cell").alias("b"), "sample")
    n = edges.join(s, "b").groupBy("a", "sample").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    return p.groupBy(F.col("a").alias("cell")).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), (1 / F.sum(F.col("p") * F.col("p"))).alias("simpson"))


def transfer_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each cell by the votes of its neighbours, each weighing 1 / (1 + distance); ties by label."""
    votes = edges.join(labels.select(F.col("cell").alias("b"), "label"), "b").groupBy("a", "label").agg(F.round(F.sum(1 / (1 + F.col("distance"))), 9).alias("w"))
    best = Window.partitionBy("a").orderBy(F.col("w").desc(), "label")
    share = F.col("w") / F.sum("w").over(Window.partitionBy("a"))
    return votes.withColumns({"_k": F.row_number().over(best), "share": share}).where("_k = 1").select(F.col("a").alias("cell"), "label", "share")


def mnn_correct(emb: DataFrame, pairs: DataFrame, reference: int, width: float, parts: int = 12, block: int = 100_000) -> DataFrame:
    """Cells shifted towards the reference sample: the mean difference of their sample's pairs, weighted by a Gaussian kernel of the distance to the pair.

    A cell of a sample without pairs, or of the reference, stays where it is. A sample's cells and its pairs are
    dealt to `parts` blocks each (more only where one would hold over `block` rows), whose weighted sums are one
    row per cell, so a row is shuffled `parts` times whatever the sample's size; a cell and a pair are no row of their own.
    """
    v = emb.select("cell", "sample", F.col("vec").cast("array<double>").alias("v"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = v.withColumnsRenamed({"cell": "a", "sample": "_sa", "v": "_va"})
    right = v.withColumnsRenamed({"cell": "b", "sample": "_sb", "v": "_vb"}).where(F.col("_sb") == reference)
    d = both.join(left, "a").join(right, "b").where(F.col("_sa") != reference)
    d = materialize(d.select("a", "b", F.col("_sa").alias("sample"), F.col("_va").alias("at"), F.zip_with("_vb", "_va", lambda x, y: x - y).alias("diff")), "pair-shifts")
    sizes = d.groupBy("sample").agg(F.count("*").alias("_p")).join(v.groupBy("sample").agg(F.count("*").alias("_c")), "sample")
    blocks = lambda n: F.greatest(F.least(F.lit(parts), F.ceil(F.col(n) / 500)), F.ceil(F.col(n) / block)).cast("int")
    sizes = F.broadcast(sizes.select("sample", blocks("_p").alias("_np"), blocks("_c").alias("_nc")))  # a row per sample
    part = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = v.join(sizes, "sample").withColumn("_i", part(["cell"], "_nc")).withColumn("_j", every("_np")).select("sample", "_i", "_j", "cell", "v")
    moves = d.join(sizes, "sample").withColumn("_j", part(["a", "b"], "_np")).withColumn("_i", every("_nc")).select("sample", "_i", "_j", "at", "diff")

    def sums(some: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(near):
            return pd.DataFrame({"cell": some["cell"][:0], "top": [], "low": []})
        x, y, z = (np.stack(c.to_numpy()) for c in (some["v"], near["at"], near["diff"]))
        middle = y.mean(axis=0)  # distances from products lose digits far from the origin
        x, y = x - middle, y - middle
        xx, yy, turned = (x * x).sum(axis=1), (y * y).sum(axis=1), np.ascontiguousarray(-2 * y.T)
        top, low, few = [], [], max(1, 1_000_000 // len(y))
        for at in range(0, len(x), few):  # so many weights at a time
            w = x[at : at + few] @ turned
            w += yy
            w += xx[at : at + few, None]
            np.maximum(w, 0, out=w)
            w /= -2 * width * width
            np.exp(w, out=w)
            top.extend(w @ z)
            low.append(w.sum(axis=1))
        return pd.DataFrame({"cell": some["cell"], "top": top, "low": np.concatenate(low)})

    keys = ["sample", "_i", "_j"]
    kind = emb.schema["cell"].dataType.simpleString()
    n = max(1, int(sizes.agg(F.sum(F.col("_np") * F.col("_nc"))).first()[0] or 0))
    cells, moves = cells.repartition(n, *keys), moves.repartition(n, *keys)  # else Spark merges the pairs of blocks to as few tasks as the cores
    met = cells.groupBy(*keys).cogroup(moves.groupBy(*keys)).applyInPandas(sums, f"cell {kind}, top array<double>, low double")
    first = v.select(F.size("v")).first()
    whole = met.groupBy("cell").agg(block_sum("top", first[0] if first else 0).alias("_top"), F.sum("low").alias("_low")).where("_low > 0")
    shift = whole.select("cell", F.transform("_top", lambda t: t / F.col("_low")).alias("_shift"))
    out = v.join(shift, "cell", "left")
    return out.select("cell", "sample", F.when(F.col("_shift").isNull(), F.col("v")).otherwise(F.zip_with("v", "_shift", lambda x, y: x + y)).alias("vec"))


def centroid_correct(emb: DataFrame, k: int, rounds: int, seed: int = 3) -> DataFrame:
    """Clusters the cells, moves each sample's centroid in a cluster onto the cluster's, and repeats."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cur = emb.select("cell", "sample", F.col("vec").cast("array<double>").alias("vec"))
    for _ in range(rounds):
        data = cur.withColumn("features", array_to_vector("vec"))
        fit = KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("cell", "sample", "vec", F.col("prediction").alias("_c"))
        long = fit.select("cell", "sample", "_c", F.posexplode("vec").alias("pos", "x"))
        mean = long.groupBy("_c", "pos").agg(F.avg("x").alias("_m"))
        own = long.groupBy("_c", "sample", "pos").agg(F.avg("x").alias("_s"))
        moved = long.join(own, ["_c", "sample", "pos"]).join(mean, ["_c", "pos"])
        cur = moved.groupBy("cell", "sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("x") - F.col("_s") + F.col("_m")).alias("x")))), lambda s: s["x"]).alias("vec"))
        cur = materialize(cur, "centroids")
    return cur


def label_propagation(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Cell groups: labels such that no cell has neighbours with a commoner label than its own: cell, label.

    A cell's own label counts as one vote. It changes only to a label with more votes, the
    smallest of these, and in a round only half of the cells (by hash) may change, so
    that neighbours do not swap for ever. An error is raised if labels still change after `most_rounds`.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both.unionByName(both.select("a", F.col("a").alias("b")).distinct()), "label-edges")
    cur = both.select(F.col("a").alias("cell")).distinct().withColumn("label", F.col("cell"))
    for turn in range(most_rounds):
        votes = both.join(cur.withColumnRenamed("cell", "b"), "b").groupBy(F.col("a").alias("cell"), "label").agg(F.count("*").alias("n"))
        voted = votes.join(cur.withColumnRenamed("label", "_was"), "cell").groupBy("cell").agg(
            F.first("_was").alias("_was"), F.max(F.when(F.col("label") == F.col("_was"), F.col("n"))).alias("_own"), F.max("n").alias("_most"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("_best")
        )
        wants = F.col("_most") > F.col("_own")
        turned = F.when(wants & (F.pmod(F.xxhash64("cell", F.lit(turn)), F.lit(2)) == 0), F.col("_best")).otherwise(F.col("_was"))
        nxt = materialize(voted.select("cell", turned.alias("label"), wants.alias("_wants")), "labels")
        if nxt.where("_wants").isEmpty():
            return nxt.select("cell", "label")
        cur = nxt.select("cell", "label")
    raise RuntimeError(f"labels not settled after {most_rounds} rounds")


def doublet_score(emb: DataFrame, pairs_per_cell: float = 0.5, k: int = 10) -> DataFrame:
    """Share of simulated doublets among each cell's neighbours.

    A doublet is the mean of two cells that stand next to each other in an order by
    hash; as many are made as `pairs_per_cell` says. Their ids are negative.
    """
    v = emb.select("cell", F.col("vec").cast("array<double>").alias("vec")).withColumn("_h", F.xxhash64("cell"))
    pick = v.where(F.pmod(F.col("_h"), F.lit(1000)) < int(1000 * pairs_per_cell)).withColumn("_g", F.pmod(F.xxhash64("_h"), F.lit(64)))
    other = F.lead("vec").over(Window.partitionBy("_g").orderBy("_h"))
    made = pick.withColumn("_o", other).where(F.col("_o").isNotNull()).select((-F.col("cell") - 1).alias("cell"), F.zip_with("vec", "_o", lambda x, y: (x + y) / 2).alias("vec"))
    edges = knn(v.select("cell", "vec").unionByName(made), k, queries=v.select("cell", "vec"))
    return edges.groupBy(F.col("a").alias("cell")).agg(F.avg(F.when(F.col("b") < 0, 1.0).otherwise(0.0)).alias("score"))


def link_products(x: DataFrame, y: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (fx, fy) the sum of products over cells that store both: fx, fy, _sxy; no row where none does.

    Made at the listed pairs: the stored values of a pair's sparser side are looked up in the other, so
    rows are pairs times cells of the sparser side. Where all pairs that meet in a cell
    are fewer rows than that, they are made instead. Both costs are known beforehand from counts (_nx and _ny of the
    pairs, if they have them).
    """
    sized = pairs
    if not {"_nx", "_ny"} <= set(pairs.columns):
        nx, ny = [df.groupBy(F.col("feature").alias(f"f{side}")).agg(F.count("*").alias(f"_n{side}")) for df, side in ((x, "x"), (y, "y"))]
        sized = materialize(pairs.select("fx", "fy").join(nx, "fx").join(ny, "fy"), "pairs")
    stored = x.count() + y.count()
    xs = x.select(F.col("feature").alias("fx"), "cell", F.col("x").alias("_x"))
    ys = y.select(F.col("feature").alias("fy"), "cell", F.col("x").alias("_y"))
    by_cell = [dealt(df, stored, "cell") for df in (xs, ys)]
    n, at_pairs = sized.agg(F.count("*"), F.sum(F.least("_nx", "_ny"))).first()
    in_cells = by_cell[0].groupBy("cell").agg(F.count("*").alias("_a")).join(by_cell[1].groupBy("cell").agg(F.count("*").alias("_b")), "cell").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    made = min(in_cells, at_pairs or 0)
    if in_cells <= (at_pairs or 0):
        both = by_cell[0].join(by_cell[1], "cell")
    else:
        left = sized.where("_nx <= _ny").select("fx", "fy").join(xs, "fx").join(ys, ["fy", "cell"])
        right = sized.where("_nx > _ny").select("fx", "fy").join(ys, "fy").join(xs, ["fx", "cell"])
        both = left.select("fx", "fy", "_x", "_y").unionByName(right.select("fx", "fy", "_x", "_y"))
    both = both.select("fx", "fy", (F.col("_x") * F.col("_y")).alias("_xy"))
    if made <= 2 * n:  # little to add up before the rows are shuffled
        return dealt(both, made, "fx", "fy").groupBy("fx", "fy").agg(F.sum("_xy").alias("_sxy"))
    return both.groupBy("fx", "fy").agg(F.sum("_xy").alias("_sxy"))


def link_corr(x: DataFrame, y: DataFrame, pairs: DataFrame, n: DataFrame) -> DataFrame:
    """Pearson correlation of features over cells for pairs (fx, fy); missing rows are zeros, n (one row, column n) the number of cells.

    Sums over stored values only; null where either is constant. A feature has one row per cell. The tables are read
    several times. Joins at the pairs are dealt by the number of pairs, so a task's share does not grow with the table.
    """
    sums = lambda df, side: df.groupBy(F.col("feature").alias(f"f{side}")).agg(F.count("*").alias(f"_n{side}"), F.sum("x").alias(f"_s{side}"), F.sum(F.col("x") * F.col("x")).alias(f"_s{side}{side}"))
    pairs = materialize(pairs.select("fx", "fy"), "pairs")
    size = pairs.count()
    sized = dealt(pairs, size, "fx").join(dealt(sums(x, "x"), size, "fx"), "fx")
    sized = materialize(dealt(sized, size, "fy").join(dealt(sums(y, "y"), size, "fy"), "fy"), "pairs")
    j = dealt(sized, size, "fx", "fy").join(dealt(link_products(x, y, sized), size, "fx", "fy"), ["fx", "fy"], "left").join(F.broadcast(n))  # n is one row
    top = F.col("n") * F.coalesce("_sxy", F.lit(0.0)) - F.col("_sx") * F.col("_sy")
    bottom = (F.col("n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")) * (F.col("n") * F.col("_syy") - F.col("_sy") * F.col("_sy"))
    return j.select("fx", "fy", (top / F.sqrt(F.when(bottom > 1e-9, bottom))).alias("corr"))


def score_sets(x: DataFrame, sets: DataFrame) -> DataFrame:
    """Mean of each cell over the features of a set, missing ones as zeros; no row where a cell has none of them."""
    own = sets.select("set_id", "feature").distinct()
    size = own.groupBy("set_id").agg(F.count("*").alias("_n"))
    return x.join(own, "feature").join(size, "set_id").groupBy("cell", "set_id").agg((F.sum("x") / F.first("_n")).alias("score"))


def bh_adjust(df: DataFrame, by: str) -> DataFrame:
    """Adds q, the Benjamini-Hochberg adjusted p, within each group (not null); ties by id.

    Ranks and the least value of the ranks from a row on are running values over range
    partitions, so a group that holds all rows is many tasks. The table is read twice, after a count.
    """
    size = df.count()
    ranked = running_totals(df.withColumn("_one", F.lit(1)), [by], ["p", "id"], "_one", "_below", size)
    ranked = ranked.join(df.groupBy(by).agg(F.count("*").alias("_n")), by)
    raw = ranked.withColumn("_raw", F.col("p") * F.col("_n") / (F.col("_below") + 1)).drop("_one", "_below", "_n")
    return running(raw, [by], ["p", "id"], "_raw", "q", F.min, after=True, own=True, size=size).withColumn("q", F.least("q", F.lit(1.0))).drop("_raw")


def null_corr(links: DataFrame, stats: DataFrame, draws: int, keys: tuple[str, ...] = ("mean", "gc"), strata: int = 5, block: int = 2000) -> DataFrame:
    """Empirical p of each link (fx, fy, corr) from `draws` links of elements alike in `keys`: fx, fy, corr, p, drawn.

    Elements (rows of `stats`: feature and the keys) are dealt to `strata` parts by each
    key. The links of a stratum stand in a circle by hash; a link's background are those that
    follow it, so each is drawn once and the link itself is left out. p = (1 + drawn ones at
    least as strong) / (1 + drawn). Places come from running sums over range partitions, and
    comparisons run in blocks of links with as many more as are drawn, so a stratum is many tasks.
    """
    for key in keys:
        stats = stats.withColumn(f"_{key}", F.ntile(strata).over(Window.orderBy(key, "feature")))  # a row per element
    strat = stats.select(F.col("feature").alias("fx"), F.concat_ws("-", *[F.col(f"_{key}") for key in keys]).alias("stratum"))
    name = F.concat_ws(":", F.col("fx").cast("string"), F.col("fy").cast("string"))
    own = links.where("corr is not null").join(strat, "fx").select("stratum", "fx", "fy", "corr", F.md5(name.cast("binary")).alias("_h"), F.lit(1).alias("_one"))
    links_n = links.count()
    placed = running_totals(own, ["stratum"], ["_h", "fx", "fy"], "_one", "at", links_n)
    size = placed.groupBy("stratum").agg(F.count("*").alias("n"))
    block = max(block, draws)
    placed = placed.join(F.broadcast(size), "stratum").withColumn("m", F.least(F.lit(draws), F.col("n") - 1))  # strata rows
    # a link at place q of the unrolled circle is compared in each block that reaches it
    twice = placed.withColumn("q", F.explode(F.when(F.col("at") < F.col("m"), F.array("at", F.col("at") + F.col("n"))).otherwise(F.array("at"))))
    first = F.greatest(F.floor((F.col("q") - F.col("m") - block) / block) + 1, F.lit(0))
    last = F.least(F.floor(F.col("q") / block), F.floor((F.col("n") - 1) / block))
    rows = twice.where(first <= last).withColumn("block", F.explode(F.sequence(first, last)))
    kinds = dict(links.dtypes)

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        m, c = int(pdf["m"].iloc[0]), pdf["corr"].to_numpy()
        mine = pdf[(pdf["q"] == pdf["at"]) & (pdf["q"] // block == key[1])]
        high = (np.lib.stride_tricks.sliding_window_view(c[1:], m)[: len(mine)] >= c[: len(mine), None]).sum(axis=1) if m else 0
        return mine[["fx", "fy", "corr"]].assign(p=(1.0 + high) / (1.0 + m), drawn=m)

    rows = rows.select("stratum", "block", "q", "at", "m", "fx", "fy", "corr")
    compared = dealt(rows, links_n * (block + draws) // block, "stratum", "block").groupBy("stratum", "block")
    return compared.applyInPandas(compare, f"fx {kinds['fx']}, fy {kinds['fy']}, corr double, p double, drawn long")


def grn_edges(hits: DataFrame, links: DataFrame, coexp: DataFrame, cut: float) -> tuple[DataFrame, DataFrame]:
    """Triples tf, pid, gene with a motif hit, a link and co-expression of at least `cut`; and edges tf, gene over them."""
    triples = hits.select("tf", "pid").distinct().join(links.select("pid", "gene", F.col("corr").alias("link")), "pid").join(coexp.select("tf", "gene", F.col("corr").alias("coexp")), ["tf", "gene"])
    triples = triples.where((F.abs("link") >= cut) & (F.abs("coexp") >= cut))
    return triples, triples.groupBy("tf", "gene").agg(F.count("*").alias("elements"), F.max(F.abs("link")).alias("link"), F.first("coexp").alias("coexp"))


def grn_ridge(design: DataFrame, penalty: float) -> DataFrame:
    """Ridge weights per target from rows (target, obs, regulator, x, y); a missing x is a zero, of repeated ones the mean counts.

    Only sums go to the solver: products of two regulators and of a regulator with y,
    summed in Spark, so a target costs the square of its regulators and not its observations.
    """
    kinds = dict(design.dtypes)
    own = design.groupBy("target", "obs", "regulator").agg(F.avg("x").alias("x"), F.min("y").alias("y"))
    y = own.groupBy("target", "obs").agg(F.min("y").alias("y")).groupBy("target").agg(F.count("*").alias("n"), F.sum("y").alias("sy"))
    one = own.groupBy("target", "regulator").agg(F.sum("x").alias("v"), F.sum(F.col("x") * F.col("y")).alias("w"))
    other = own.select("target", "obs", F.col("regulator").alias("other"), F.col("x").alias("_x"))
    two = own.join(other, ["target", "obs"]).where("regulator <= other").groupBy("target", "regulator", "other").agg(F.sum(F.col("x") * F.col("_x")).alias("v"))
    sums = one.withColumn("other", F.lit(None).cast(kinds["regulator"])).unionByName(two.withColumn("w", F.lit(None).cast("double"))).join(y, "target")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        single = pdf[pdf["other"].isna()].sort_values("regulator")
        pair = pdf[pdf["other"].notna()]
        at = {r: i for i, r in enumerate(single["regulator"])}
        gram = np.zeros((len(at), len(at)))
        i, j = pair["regulator"].map(at).to_numpy(int), pair["other"].map(at).to_numpy(int)
        gram[i, j] = gram[j, i] = pair["v"].to_numpy()
        n, sy, sx = single["n"].iloc[0], single["sy"].iloc[0], single["v"].to_numpy()
        w = np.linalg.solve(gram - np.outer(sx, sx) / n + penalty * np.eye(len(at)), single["w"].to_numpy() - sx * sy / n)
        return pd.DataFrame({"target": key[0], "regulator": single["regulator"], "weight": w})

    return sums.groupBy("target").applyInPandas(solve, f"target {kinds['target']}, regulator {kinds['regulator']}, weight double")


def regulon_activity(rna: DataFrame, sets: DataFrame, top: int) -> DataFrame:
    """Per cell and set: share of the cell's `top` highest features that are in the set, weighted by how high they rank."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("x").desc(), "feature"))
    best = rna.withColumn("_k", rank).where(F.col("_k") <= top)
    score = F.sum(top + 1 - F.col("_k"))
    return best.join(sets.select("set_id", "feature").distinct(), "feature").groupBy("cell", "set_id").agg(F.count("*").alias("n"), (score / (top * (top + 1) / 2)).alias("activity"))


def network_degree(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest degree with in and out degree; ties by node."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    deg = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return deg.orderBy((F.col("n_out") + F.col("n_in")).desc(), "node").limit(k)


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, most_rounds: int = 1000) -> DataFrame:
    """Centrality that sums to one: node, rank; the rank of nodes without out-edges is dealt to all.

    Rounds end when the ranks' changes add up to at most `tolerance` (they shrink by
    `damping` a round); an error is raised if they do not. Repeated edges count once.
    """
    pairs = edges.select("src", "dst").distinct()
    e = materialize(pairs.join(pairs.groupBy("src").agg((1 / F.count("*")).alias("_w")), "src"), "rank-edges")
    nodes = materialize(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "rank-nodes")
    n = nodes.count()
    cur = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(most_rounds):
        flow = e.join(cur.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("_w") * F.col("rank")).alias("_in"))
        got = flow.agg(F.coalesce(F.sum("_in"), F.lit(0.0)).alias("_all"))
        nxt = cur.join(flow, "node", "left").join(F.broadcast(got))  # one row
        lost = (1.0 - F.col("_all")) / max(n, 1)
        rank = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("_in", F.lit(0.0)) + lost)
        cur = materialize(nxt.select("node", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("_change")), "ranks")
        change = cur.agg(F.sum("_change")).first()[0] or 0.0
        cur = cur.select("node", "rank")
        if change <= tolerance:
            return cur
    raise RuntimeError(f"ranks not settled after {most_rounds} rounds: they still change by {change:.1e}")


def network_diff(one: DataFrame, two: DataFrame, change: float) -> DataFrame:
    """Edges of either network as gained, lost, changed (weights differ by more than `change`) or same."""
    j = one.select("src", "dst", F.col("weight").alias("w1")).join(two.select("src", "dst", F.col("weight").alias("w2")), ["src", "dst"], "full_outer")
    state = F.when(F.col("w1").isNull(), "gained").when(F.col("w2").isNull(), "lost").when(F.abs(F.col("w1") - F.col("w2")) > change, "changed").otherwise("same")
    return j.select("src", "dst", "w1", "w2", state.alias("state"))


def network_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Connected modules: the smallest node reachable from each, by rounds of minimum labels with pointer jumps."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "module-edges")
    cur = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "modules")
    for _ in range(most_rounds):
        near = both.join(cur.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        low = cur.join(near, "node").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("label"))
        jump = cur.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        nxt = materialize(low.join(jump, "label", "left").select("node", "_was", F.least("label", F.coalesce("_next", "label")).alias("label")), "modules")
        settled = nxt.where("_was <> label").isEmpty()
        cur = nxt.select("node", "label")
        if settled:
            return cur
    raise RuntimeError(f"modules not settled after {most_rounds} rounds")


def metacell_counts(counts: DataFrame, pools: DataFrame) -> DataFrame:
    """Counts summed over the cells of each metacell (cell, metacell): metacell, feature, x, cells with the feature."""
    return counts.join(pools, "cell").groupBy("metacell", "feature").agg(F.sum("x").alias("x"), F.count("*").alias("cells"))


def metacells(emb: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """Pools of similar cells: n clusters by KMeans; cell, metacell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = emb.select("cell", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return KMeans(k=n, seed=seed, maxIter=15).fit(data).transform(data).select("cell", F.col("prediction").alias("metacell"))
