"""Shared steps of the near-duplicate joins: links inside buckets, and exact counts inside components.

A join goes in two phases. First, buckets propose: in each bucket a few leaders
stand for their neighbourhoods, and a row of edges, never all pairs, ties a member
to the leaders near it. The components of these edges hold every pair that any
bucket could link. Second, all pairs inside a component are compared exactly, in
blocks, and only counts per node and a spanning forest of the links come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import join_facts, materialize

#: From two matrices of decoded payloads to the matrix of their similarities.
Similarity = Callable[[np.ndarray, np.ndarray], np.ndarray]


def leader_edges(rows: DataFrame, decode: Callable[[list[bytes]], np.ndarray], similarity: Similarity, rowwise: Similarity, join_at: float, link_at: float) -> DataFrame:
    """Edges (bucket, a, b) from rows (bucket, node, payload, split).

    Members of a bucket come one after another; one that is at least `join_at`
    similar to a leader joins it, else it becomes a leader. A member is tied to
    every leader at least `link_at` similar. If dissimilarity is a metric and
    (1 - link_at) >= (1 - join_at) + (1 - the join's threshold) in its terms, two
    members over the threshold share a leader. Of these ties only those are given
    that join something new, fewer than members and leaders together. A leader of a
    split bucket gives one row with a = b. Only the leaders of the bucket at hand
    are held in memory. `rowwise` compares two matrices row by row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, leaders, ids, same = None, None, None, {}
        for pdf in (part for batch in batches for part in _alike(batch)):
            key, node, data, split = pdf["bucket"].to_numpy(), pdf["node"].to_numpy(), decode(pdf["payload"].tolist()), pdf["split"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(cuts)
            sizes[-1] = 3  # the last bucket may go on in the next batch
            pair = cuts[:-1][(sizes == 2) & (key[cuts[:-1]] != bucket) & ~split[cuts[:-1]]]
            pair_near = pair[rowwise(data[pair + 1], data[pair]) >= link_at]
            out = [(key[pair_near], node[pair_near + 1], node[pair_near])]
            done = np.zeros(len(key), bool)
            done[pair] = True
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if done[s]:
                    continue
                if key[s] != bucket:
                    bucket, leaders, ids, same = key[s], data[s : s + 1], node[s : s + 1], {}
                    if split[s]:
                        out.append((key[s : s + 1], ids, ids))
                    s += 1
                for at in range(s, e, 512):
                    x, who = data[at : min(at + 512, e)], node[at : min(at + 512, e)]
                    sim = similarity(x, leaders)
                    loose = np.flatnonzero(sim.max(axis=1) < join_at)
                    if len(loose):  # new leaders, in order, among those that joined none
                        inner, new = similarity(x[loose], x[loose]), []
                        for i in range(len(loose)):
                            if not new or inner[i, new].max() < join_at:
                                new.append(i)
                        fresh = loose[new]
                        sim = np.concatenate([sim, similarity(x, x[fresh])], axis=1)
                        leaders, ids = np.concatenate([leaders, x[fresh]]), np.concatenate([ids, who[fresh]])
                        if split[at]:
                            out.append((np.full(len(fresh), bucket), who[fresh], who[fresh]))
                    a, b = _ties(who, ids, sim >= link_at, same)
                    out.append((np.full(len(a), bucket), np.array(a, np.int64), np.array(b, np.int64)))
            yield pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("bucket", "a", "b"))})

    return rows.select("bucket", "node", "payload", "split").repartition("bucket").sortWithinPartitions("bucket", "node").mapInPandas(run, "bucket long, a long, b long")


def _alike(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Stretches of rows whose payloads have one length, as all of a bucket have."""
    size = pdf["payload"].str.len().to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1], [True]])) if len(pdf) else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield pdf.iloc[s:e]


def _ties(who: np.ndarray, ids: np.ndarray, near: np.ndarray, same: dict[int, int]) -> tuple[list[int], list[int]]:
    """Edges from members to leaders: the first leader near a member, and others not yet joined to it.

    `same` leads from a leader to another that it was joined to before, if any.
    """

    def root(j: int) -> int:
        while j in same:
            if same[j] in same:
                same[j] = same[same[j]]
            j = same[j]
        return j

    a, b = [], []
    first = near.argmax(axis=1)
    several = near.sum(axis=1) > 1
    plain = near.any(axis=1)
    tie = plain & (who != ids[first])
    a += who[tie].tolist()
    b += ids[first[tie]].tolist()
    for i in np.flatnonzero(several):
        r = root(int(first[i]))
        for j in np.flatnonzero(near[i])[1:].tolist():
            other = root(j)
            if other != r:
                lo, hi = min(r, other), max(r, other)
                same[hi] = r = lo
                if who[i] != ids[j]:
                    a.append(int(who[i])), b.append(int(ids[j]))
    return a, b


def salted_leader_edges(rows: DataFrame, decode, similarity: Similarity, rowwise: Similarity, join_at: float, link_at: float, meet_at: float, salt_rows: int = 20_000, block: int = 1000) -> DataFrame:
    """Edges (a, b); buckets of over `salt_rows` rows are dealt to several groups.

    `rows` also has the bucket's size. The leaders of the groups of one bucket meet
    in a second step at `meet_at`, which allows for a leader's distance on both sides.
    They may be nearly all rows of a bucket, so they meet as pairs of blocks of about
    `block` leaders, spread over tasks.
    """
    salt = F.pmod(F.xxhash64("node"), F.greatest(F.ceil(F.col("size") / salt_rows), F.lit(1)))
    salted = rows.withColumns({"first": F.col("bucket"), "split": F.col("size") > salt_rows, "bucket": F.when(F.col("size") > salt_rows, F.xxhash64("bucket", salt)).otherwise(F.col("bucket"))})
    one = leader_edges(salted, decode, similarity, rowwise, join_at, link_at)
    one = materialize(one, "leaders")
    heads = one.where("a = b").select("bucket", F.col("a").alias("node"))
    again = salted.where("split").join(heads, ["bucket", "node"]).select(F.col("first").alias("component"), "node", "payload", F.lit(1).cast("long").alias("weight"))

    def pairs(x: list[bytes], y: list[bytes] | None) -> np.ndarray:
        left = decode(x)
        return similarity(left, left if y is None else decode(y))

    two = count_links(blocked(again, block), pairs, meet_at).where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))
    return one.select("a", "b").unionByName(two).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def blocked(members: DataFrame, block: int, salts: int = 64) -> DataFrame:
    """Deals members (component, node, ...) into tasks that together meet every pair of a component once.

    Adds job (long), left and right (boolean). A component of at most `block`
    members is one job, in which all are left and right; many small ones share a
    task by hash. A larger one is cut into blocks by hash of the node, and each two
    blocks, or one with itself, are a job. Members learn whether their component is a large one by a
    join salted with the node, so that no task gets a component whole.
    """
    large = members.groupBy("component").agg(F.count("*").alias("_size")).where(F.col("_size") > block)
    large = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(salts)).cast("int"))
    own = salted.join(large, ["component", "_salt"], "left").drop("_salt")
    own = own.withColumn("_n", F.coalesce(F.ceil(F.col("_size") / block), F.lit(1)).cast("int")).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    lo, hi = F.least("_b", "_o"), F.greatest("_b", "_o")
    return own.withColumns({"job": F.xxhash64("component", lo, hi), "left": F.col("_b") == lo, "right": F.col("_b") == hi}).drop("_n", "_b", "_o", "_size")


def count_links(jobs: DataFrame, similarity_of: Callable[[list[bytes], list[bytes] | None], np.ndarray], threshold: float) -> DataFrame:
    """Rows (node, n_links, to) from jobs (job, left, right, node, weight, payload).

    n_links: summed weight of the nodes of the job linked to the node. `to`: nodes
    that tie it into a spanning forest of the job's links, null in the rows with counts.
    `similarity_of(left, right)` compares payloads; right is None for a job on itself.
    """

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame | None:
        left, right = pdf[pdf["left"]], pdf[pdf["right"]]
        same = bool((pdf["left"] & pdf["right"]).all())
        if len(left) < 1 or len(right) < 1 or (same and len(left) < 2):
            return None
        ok = similarity_of(left["payload"].tolist(), None if same else right["payload"].tolist()) >= threshold
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        if same:
            np.fill_diagonal(ok, False)
        counts = [(a, ok @ right["weight"].to_numpy())] + ([] if same else [(b, ok.T @ left["weight"].to_numpy())])
        node = np.concatenate([x for x, _ in counts])
        n = np.concatenate([x for _, x in counts])
        x, y = _forest(ok, same)
        return pd.DataFrame({"node": np.concatenate([node, a[x]]), "n_links": np.concatenate([n, np.zeros(len(x), np.int64)]), "to": pd.array([None] * len(node) + b[y].tolist(), "Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            job = pdf["job"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], job[1:] != job[:-1]])) if len(job) else np.array([], int)
            out = [pairs(pdf.iloc[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            rest = pdf.iloc[cuts[-1] :] if len(cuts) else None
            yield from _joined(out)
        if rest is not None and len(rest):
            yield from _joined([pairs(rest)])

    return jobs.select("job", "left", "right", "node", "weight", "payload").repartition("job").sortWithinPartitions("job", "node").mapInPandas(run, "node long, n_links long, to long")


def _joined(frames: list[pd.DataFrame | None]) -> list[pd.DataFrame]:
    frames = [x for x in frames if x is not None]
    return [pd.concat(frames, ignore_index=True)] if frames else []


def _forest(ok: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what `ok` joins, fewer than its rows and columns together."""
    n, m = ok.shape
    done_l, done_r = np.zeros(n, bool), np.zeros(m, bool)
    xs: list[int] = []
    ys: list[int] = []
    for i in range(n):
        if done_l[i]:
            continue
        todo, done_l[i] = [i], True
        while todo:
            k = todo.pop()
            new = np.flatnonzero(ok[k] & ~done_r)
            if same:
                new = new[~done_l[new]]
                done_l[new] = done_r[new] = True
                todo += new.tolist()
            else:
                done_r[new] = True
                for r in new.tolist():
                    back = np.flatnonzero(ok[:, r] & ~done_l)
                    done_l[back] = True
                    xs += back.tolist()
                    ys += [r] * len(back)
                    todo += back.tolist()
            xs += [k] * len(new)
            ys += new.tolist()
    return np.array(xs, int), np.array(ys, int)


def component_ids(components: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, component_id): the smallest class_id in the component of each node."""
    named = materialize(components.join(classes.select("node", "class_id"), "node"), "named")
    least = materialize(named.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")), "named")
    return join_facts(named.select("node", "component"), least.select("component", "component_id"), "component", least, named.count()).select("node", "component_id")
