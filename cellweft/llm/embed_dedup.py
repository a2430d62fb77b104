"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosine checks.

Vectors are scaled to length 1, where cosine c is distance sqrt(2 - 2 c). Each of
several tables hashes a vector by k random projections, shifted and cut into steps
of `width`; vectors with equal steps share a bucket. k grows with the logarithm of
the number of vectors, which keeps buckets small, and the number of tables follows
from the recall asked for at the threshold itself; closer pairs are found almost
surely, and every pair inside a found component is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm import textvec as tv
from cellweft.llm.clusters import blocked, component_ids, count_links, salted_leader_edges
from cellweft.llm.common import join_facts, materialize, table
from cellweft.llm.graph import connected_components

NO_ID = 2**63 - 1  # stands for a null vec_id inside


def same_step(distance: float, width: float) -> float:
    """Chance that a Gaussian projection puts two vectors of a distance into one step."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float, recall: float, width: float, bucket: float = 50.0) -> tuple[int, int]:
    """Projections per table, so that about `bucket` unrelated vectors share one, and tables."""
    far, near = same_step(math.sqrt(2), width), same_step(math.sqrt(2 - 2 * threshold), width)
    k = max(1, round(math.log(max(n / bucket, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _payloads(vectors: DataFrame) -> DataFrame:
    """Rows vec_id, set (digest), payload (doubles); null payload where a vector can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, digest = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v is not None else np.zeros(0)
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                payload.append((x + 0.0).tobytes() if good else None)
                words = np.frombuffer(payload[-1], np.uint64) if good else np.zeros(1, np.uint64)
                digest.append(int(tv.mix64((tv.mix64(words + np.arange(len(words), dtype=np.uint64)) * (2 * np.arange(len(words), dtype=np.uint64) + np.uint64(1))).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.int64()), pa.array(payload, pa.binary())], ["vec_id", "node", "payload"])

    return vectors.mapInArrow(run, "vec_id long, node long, payload binary")


def _unit(payloads: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to norm 1; by the largest component first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(payloads), np.float64).reshape(len(payloads), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(classes: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """Rows (node, bucket): the bucket of each vector in each table, vectors of each length apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = tv.mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        salt = tv.mix64(np.arange(tables, dtype=np.uint64) + np.uint64(seed))
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def projections(dim: int, table: int, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Directions and shifts of n tables from `table` on; kept for lengths that are small."""
            if (dim, table) in known:
                return known[dim, table]
            rng = np.random.default_rng([seed, dim, table])
            made = rng.standard_normal((dim, n * k)), rng.uniform(0, width, n * k)
            if dim <= 4096:
                known[dim, table] = made
            return made

        def keys(x: np.ndarray) -> np.ndarray:
            dim, out = x.shape[1], []
            n = max(1, min(tables, (1 << 22) // (dim * k)))  # tables at a time, to bound memory for long vectors
            for t in range(0, tables, n):
                m = min(n, tables - t)
                a, b = projections(dim, t, m)
                step = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), m, k)
                out.append(tv.mix64(tv.mix64((tv.mix64(step) * odd).sum(axis=2, dtype=np.uint64)) ^ salt[t : t + m] ^ tv.mix64(np.array([dim], np.uint64))).view(np.int64))
            return np.concatenate(out, axis=1)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                payloads = part.column(1).to_pylist()
                sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
                key = np.empty((len(payloads), tables), np.int64)
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    key[own] = keys(_unit([payloads[i] for i in own]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * tables), pa.array(key.ravel()))], ["node", "buckets"])

    return classes.select("node", "payload").mapInArrow(run, "node long, buckets array<long>").select("node", F.explode("buckets").alias("bucket"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.95, width: float = 2.0, block: int = 2000, seed: int = 11, around: float = 0.25) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links: other rows with cosine of at least `threshold` in double precision,
    among the pairs found; component_id: smallest vec_id reachable by links; kept:
    whether it is the row itself.

    Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing. Vectors of different lengths do not link. Null vec_id: takes part as
    the largest id. Repeated rows link with each other. Empty table: empty. Columns other
    than vec_id and embedding are not read.
    """
    own = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(_payloads(own), "vectors")
    classes = rows.where("payload is not null").groupBy("node").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight"), F.first("payload").alias("payload"))
    classes = materialize(classes, "vector-classes")
    k, tables = plan(classes.count(), threshold, recall, width)
    keys = materialize(_buckets(classes, k, tables, width, seed), "vector-buckets")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    ready = keys.join(sizes, "bucket").join(classes.select("node", "payload"), "node")
    reach = math.sqrt(2 - 2 * threshold)
    cosine = lambda d: 1 - d * d / 2 - 1e-9
    edges = salted_leader_edges(ready, _unit, lambda x, y: x @ y.T, lambda x, y: (x * y).sum(axis=1), cosine(around), cosine(around + reach), cosine(2 * around + reach))
    candidates = connected_components(edges)
    members = materialize(candidates.join(classes, "node"), "vector-members")
    pairs = lambda x, y: _unit(x) @ _unit(x if y is None else y).T
    links = materialize(count_links(blocked(members, block), pairs, threshold), "vector-links")
    n_links = links.groupBy("node").agg(F.sum("n_links").alias("other"))
    exact = connected_components(links.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = component_ids(exact, classes)
    info = classes.select("node", "class_id", "weight").join(n_links, "node", "left").join(named, "node", "left")
    info = info.select("node", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    alone = rows.where("payload is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    info, valid = materialize(info, "vector-classes"), rows.where("payload is not null").select("vec_id", "node")
    out = join_facts(valid, info, "node", classes.select("node", F.col("weight").alias("n")), valid.count())
    out = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(known("vec_id").alias("vec_id"), "n_links", known("component_id").alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op3_embed_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
