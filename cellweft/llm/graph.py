"""Connected components of an edge table by label contraction, a few joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import join_facts, materialize


def connected_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows (node, component) for every end of an edge; component is its smallest reachable node.

    `edges` has columns a and b (long). Alternates large-star and small-star
    steps, which shrink paths to stars in a logarithmic number of rounds, until nothing
    changes; an error is raised if that is not so after `most_rounds`. The edges of a
    node are never gathered: each step is a grouped minimum and a join, in which nodes with
    many edges are spread. Every round is written to the shared folder. No edges: no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "components")
    count = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = count(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        low = materialize(low.select("a", F.least("a", "m").alias("m"), "n"), "star")
        # large star: larger neighbours of a node hang on the smallest node around it
        large = join_facts(both.where("b > a"), low.select("a", "m"), "a", low, 2 * seen[0])
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "star")
        # small star: a node and its smaller neighbours hang on the smallest of these
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = join_facts(large, small.select("a", "m"), "a", small, seen[0])
        nxt = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(nxt, "components")
        now = count(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
