"""Approximate nearest neighbours by descent over a growing neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.tables import materialize

_EDGE = "a long, b long, distance double"


def _near(x: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows; infinite from a row to itself."""
    square = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    return d


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))


def _first_graph(v: DataFrame, width: int, tables: int, block: int) -> DataFrame:
    """Neighbours among cells that lie next to each other along random directions.

    Each direction is a sort by range partitions; runs of `block` cells, each sharing half of
    the last one, are compared, so no group depends on how the cells are spread. One more order, by hash,
    ties places that are far from each other, so that the graph does not fall into parts.
    """

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                lines = np.random.default_rng(x.shape[1]).normal(size=(x.shape[1], tables))
                mixed = pdf["cell"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for t, place in enumerate([*(x @ lines).T, (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) / 2.0**64]):
                    yield pdf.assign(line=t, place=place)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            while len(rest) >= 2 * block:
                yield best(rest[:block])
                rest = rest[block // 2 :]
        if rest is not None and len(rest) > 1:
            yield best(rest)

    def best(part: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(part["vec"].to_numpy()).astype(float), part["cell"].to_numpy()
        d = _near(x)
        m = min(width, len(ids) - 1)
        j = np.argpartition(d, m - 1, axis=1)[:, :m].ravel()
        i = np.repeat(np.arange(len(ids)), m)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "distance": _exact(x, i, j)})

    placed = v.mapInPandas(project, f"cell long, vec {v.schema['vec'].dataType.simpleString()}, line int, place double")
    return placed.repartitionByRange("line", "place", "cell").sortWithinPartitions("line", "place", "cell").mapInPandas(runs, _EDGE).where("a <> b")


def _best(edges: DataFrame, width: int) -> DataFrame:
    """The `width` nearest of each cell (rows a, b, distance, fresh), repeats as one, fresh only if all are."""
    one = edges.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= width)


def meetings(graph: DataFrame, width: int, turn: int) -> DataFrame:
    """Who meets at each cell: at, cell, fresh. The cell itself, its neighbours, and of the cells it is a neighbour of some `width` by hash."""
    back = graph.groupBy("b").agg(F.count("*").alias("_n"))
    luck = (F.xxhash64("a", "b", F.lit(turn)) / float(1 << 64)) + 0.5
    some = graph.join(back, "b").where(luck * F.col("_n") < width).select(F.col("b").alias("at"), F.col("a").alias("cell"), "fresh")
    both = graph.select(F.col("a").alias("at"), F.col("b").alias("cell"), "fresh").unionByName(some)
    own = graph.select("a").distinct().select(F.col("a").alias("at"), F.col("a").alias("cell"), F.lit(False).alias("fresh"))
    return both.unionByName(own).groupBy("at", "cell").agg(F.max("fresh").alias("fresh"))


def knn_descent(emb: DataFrame, k: int, width: int | None = None, tables: int = 4, block: int = 256, settled: float = 0.002, most_rounds: int = 40) -> DataFrame:
    """Some of the k nearest cells of each cell by Euclidean distance: a, b, distance, rank. Approximate; distances are exact.

    A first graph comes from runs along a few random directions. In each round the
    neighbours of a cell, and some cells whose neighbour it is, meet at it, and pairs of which
    one is new and that are nearer than what either has are kept. At a cell meet some
    2 * `width` cells, whatever the size of the table, so a round costs cells * width. Rounds end
    when fewer than `settled` of the graph's edges are new, else an error is raised.
    `width` (2 k if not given) is the size of the lists that are kept on the way: larger
    ones find more. Vectors must be of one length; of cells at equal distance any may come.
    """
    width = width or 2 * k
    # singles are computed with as doubles, but stay singles where they are shuffled
    kind = "array<float>" if emb.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>"
    v = materialize(emb.select(F.col("cell").cast("long").alias("cell"), F.col("vec").cast(kind).alias("vec")), "vectors")
    graph = materialize(_best(_first_graph(v, width, tables, block).withColumn("fresh", F.lit(True)), width), "graph")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b, near = [], [], []
            for group in pdf["group"]:
                if len(group) < 2:
                    continue
                x = np.array([g["vec"] for g in group], float)
                ids, fresh = np.array([g["cell"] for g in group]), np.array([g["fresh"] for g in group])
                worst = np.array([g["worst"] for g in group])
                i, j = np.nonzero((_near(x) < worst[:, None] + 1e-9) & (fresh[:, None] | fresh[None, :]))
                a.append(ids[i])
                b.append(ids[j])
                near.append(_exact(x, i, j))
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "distance": np.concatenate(near)})

    for turn in range(most_rounds):
        # a list that is not full takes anything
        worst = graph.groupBy("a").agg(F.max("distance").alias("_w"), F.count("*").alias("_n"))
        known = v.join(worst, v["cell"] == worst["a"], "left").select("cell", "vec", F.when(F.col("_n") >= width, F.col("_w")).otherwise(float("inf")).alias("worst"))
        met = materialize(meetings(graph, width, turn), "meetings")
        met = met.join(met.where("fresh").select("at").distinct(), "at", "left_semi")  # without a new one nothing is compared
        groups = met.join(known, "cell").groupBy("at").agg(F.collect_list(F.struct("cell", "fresh", "worst", "vec")).alias("group"))  # some 2 * width each
        found = groups.select("group").mapInPandas(meet, _EDGE)
        both = graph.select("a", "b", "distance", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
        graph = materialize(_best(both, width), "graph")
        n, new = graph.agg(F.count("*"), F.count(F.when(F.col("fresh"), 1))).first()
        if new <= settled * n:
            return graph.where(F.col("rank") <= k).select("a", "b", "distance", "rank")
    raise RuntimeError(f"neighbours not settled after {most_rounds} rounds: {new} of {n} are new")
