"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. Each set is embedded in T MinHash
coordinates, of which two sets share a share that estimates their Jaccard
similarity. A run starts with all sets in one bucket, splits it by one coordinate, and
goes on splitting buckets by the values of a few coordinates sampled for each of them
(more than 1 / threshold, so that the branches that keep a pair together multiply and
it is not lost, however often buckets are split). A bucket is compared directly if it
is small, or tight: it keeps so much of the bucket that it came from that two parts of
that share would need as many comparisons as itself. Enough runs, each
with a coordinate of its own, are made that a pair at the threshold is met with
probability `recall` or more after the splits of all levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm import textvec as tv
from cellweft.llm.clusters import blocked, component_ids, count_links, salted_leader_edges
from cellweft.llm.common import join_facts, materialize, table
from cellweft.llm.graph import connected_components

T = 64
#: Stands for a null doc_id inside: larger than all others.
NO_ID = 2**63 - 1
_MULT = tv.mix64(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the bounds of the texts.

    A text of fewer than n words has one shingle, all its words; one without words none.
    """
    buf, offsets = tv.joined(texts)
    h, doc = tv.words(buf, offsets, ~tv.SPACE[buf])
    g, d = tv.ngrams(h, doc, n)
    count = np.bincount(doc, minlength=len(texts))
    for few in range(1, n):
        short = np.flatnonzero(count == few)
        if len(short):
            pick = np.isin(doc, short)
            g2, d2 = tv.ngrams(h[pick], doc[pick], few)
            g, d = np.concatenate([g, g2]), np.concatenate([d, d2])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        g, d = g[first], d[first]
    return g, np.searchsorted(d, np.arange(len(texts) + 1))


def _digest(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, whatever the order of its members; no members: 0."""
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix64(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    total = s[at[1:]] - s[at[:-1]]
    x = tv.mix64(total + (at[1:] - at[:-1]).astype(np.uint64) * np.uint64(0x14057B7EF767814F))
    return np.where(at[1:] > at[:-1], x | np.uint64(1), np.uint64(0)).view(np.int64)


def _signatures(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """T values of 32 bits per set (zeros for the empty set)."""
    out = np.zeros((len(at) - 1, T), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        low = at[:-1][full]
        for i in range(T):
            least = np.minimum.reduceat(g * _MULT[i], low)
            out[full, i] = (tv.mix64(least) >> np.uint64(32)).astype(np.uint32)
    return out


def sketch(docs: DataFrame, n: int = 5) -> DataFrame:
    """Rows doc_id, set (digest of the shingle set), payload (its signature); the text is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, sigs = tv.text_column(batch, "text"), [], []
            for a, b in tv.groups(texts):
                g, at = shingles(texts[a:b], n)
                ids.append(_digest(g, at))
                sigs += [x.tobytes() for x in _signatures(g, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "set", "payload"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set long, payload binary")


def _decode(payloads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), T)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of all pairs; many pairs one coordinate at a time, to bound memory."""
    if len(x) * len(y) <= 1 << 14:
        return (x[:, None, :] == y[None, :, :]).mean(axis=2, dtype=np.float32)
    out = np.zeros((len(x), len(y)), np.uint8)
    for i in range(T):
        out += x[:, i, None] == y[None, :, i]
    return out / np.float32(T)


def _rowwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1, dtype=np.float32)


def _value(i: Column) -> Column:
    """Coordinate i of the signature as hexadecimal digits."""
    return F.substring("hex", i * 8 + 1, F.lit(8))


def _draws(level: int) -> int:
    """Coordinates that a bucket is split by: one at the root of a run, then more than 1 / threshold."""
    return (1, 4)[level] if level < 2 else 2


def _chosen(bucket: Column, used: Column, n: int) -> Column:
    """n coordinates sampled for a bucket, other than those on its path (bits of `used`)."""
    free = F.filter(F.sequence(F.lit(0), F.lit(T - 1)), lambda i: F.call_function("getbit", used, i) == 0)
    order = F.array_sort(F.transform(free, lambda i: F.struct(F.xxhash64(bucket, i).alias("key"), i.alias("i"))))
    return F.transform(F.slice(order, 1, n), lambda x: x["i"])


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def missed(threshold: float, runs: int, depth: int) -> float:
    """Probability that a pair at the threshold is in one bucket of no run after `depth` levels of splits.

    By the number k of coordinates that the pair shares, of which a bucket on a path of
    j splits has k - j left among T - j. A bucket that holds the pair loses it when all
    of its draws do.
    """
    total = 0.0
    for k in range(T + 1):
        lost = 0.0
        for j in range(depth - 1, 0, -1):
            share = max(k - j, 0) / (T - j)
            lost = (1 - share + share * lost) ** _draws(j)
        roots = sum(math.comb(k, r) * math.comb(T - k, runs - r) * lost**r for r in range(runs + 1)) / math.comb(T, runs)
        total += math.comb(T, k) * threshold**k * (1 - threshold) ** (T - k) * roots
    return total


def root_coordinates(threshold: float, recall: float, depth: int = 8, seed: int = 1) -> list[int]:
    """Coordinates at the roots of the runs: as many as make a pair at the threshold meet with probability `recall`."""
    n = next((n for n in range(1, T) if missed(threshold, n, depth) <= 1 - recall), T)
    order = np.argsort(tv.mix64(np.arange(T, dtype=np.uint64) + np.uint64(seed << 32)))
    return sorted(int(x) for x in order[:n])


def paths(sets: DataFrame, threshold: float, recall: float, small: int = 2000, tight: float = math.sqrt(0.5), depth: int = 8) -> DataFrame:
    """Rows (bucket, node, payload, size) to compare directly, from rows (node, payload)."""
    total = sets.count()
    tall = sets.withColumn("hex", F.hex("payload"))
    roots = F.array(*[F.struct(F.xxhash64(F.lit(i), _value(F.lit(i))).alias("bucket"), _bit(F.lit(i)).alias("used")) for i in root_coordinates(threshold, recall, depth)])
    level = tall.select("node", F.inline(roots), F.lit(total).cast("long").alias("parent"))
    done = None
    for step in range(depth):
        last = step == depth - 1
        ready = (F.col("size") <= small) | (F.col("size") >= tight * F.col("parent")) | F.lit(last)
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size"), F.max("parent").alias("parent"), F.max("used").alias("used")).where("size > 1")
        sizes = sizes.select("bucket", "size", "used", F.when(~ready, _chosen(F.col("bucket"), F.col("used"), _draws(step + 1))).alias("picks"))
        level = materialize(level.select("node", "bucket").join(sizes, "bucket"), "paths")
        out = level.where("picks is null").select("bucket", "node", "size")
        done = out if done is None else done.unionByName(out)
        open_rows = level.where("picks is not null")
        if last or open_rows.isEmpty():
            break
        wide = open_rows.join(tall.select("node", "hex"), "node")
        split = F.transform("picks", lambda i: F.struct(F.xxhash64("bucket", i, _value(i)).alias("bucket"), F.col("used").bitwiseOR(_bit(i)).alias("used")))
        level = wide.select("node", F.col("size").alias("parent"), F.inline(split))
    return done.join(sets, "node")


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    """Rows with the text replaced by set, the digest of its shingle set, and payload, the sorted hashes."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, ids = tv.text_column(batch, "text"), [], []
            for a, b in tv.groups(texts):
                g, at = shingles(texts[a:b], n)
                ids += _digest(g, at).tolist()
                rows += [g[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], [*rest, "set", "payload"])

    return docs.select(*rest, "text").mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest) + ", set long, payload binary")


def exact_jaccard(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
    """Jaccard similarity of all pairs of sets of 64-bit hashes, through the shingles that two of them share."""
    both = left if right is None else left + right
    sets = [np.frombuffer(x, np.uint64) for x in both]
    size = np.array([len(s) for s in sets])
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    keep = np.bincount(col)[col] > 1
    who = who[keep]
    col = np.unique(col[keep], return_inverse=True)[1]
    n = len(left)
    m = n if right is None else len(sets) - n
    common = np.zeros((n, m), np.float32)
    width = max(256, min(8192, (1 << 24) // max(1, len(sets))))
    bounds = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if s == e:
            continue
        x = np.zeros((len(sets), width), np.float32)
        x[who[s:e], col[s:e] - k * width] = 1
        common += x[:n] @ (x[:n].T if right is None else x[n:].T)
    a, b = size[:n], size if right is None else size[n:]
    return common / np.maximum(a[:, None] + b[None, :] - common, 1)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999999, block: int = 1000) -> DataFrame:
    """One row per row of `docs`: doc_id; class_id, the smallest doc_id with the same shingle set;
    n_links, how many other rows have a set at least `threshold` similar;
    component_id, the smallest doc_id reachable by links; kept, whether that is the
    row itself. Only doc_id and text are read.

    Null and empty texts (no words) link with nothing: each is its own component.
    Fewer than `n` words: all words are one shingle. Null doc_id: takes part like
    any other, as the largest id. Repeated rows link with each other. Empty table: empty.
    Other columns, whatever their names, are not read. A text is read whole, in one task, in
    some 60 times its length of memory.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(sketch(own, n), "jaccard-sketch")
    classes = rows.where("set <> 0").groupBy("set").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("weight"), F.min("payload").alias("payload"))
    classes = materialize(classes.withColumnRenamed("set", "node"), "jaccard-classes")
    # 1. candidate components. A leader stands for sets at distance 1 - t or less; a
    # member within 1 - t of one of these is within 2 (1 - t) of the leader. `slack`
    # allows five standard deviations of the estimate.
    slack = 5 * math.sqrt(threshold * (1 - threshold) / T)
    ready = paths(classes.select("node", "payload"), threshold, recall)
    edges = salted_leader_edges(ready, _decode, _agreement, _rowwise, threshold, 1 - 2 * (1 - threshold) - slack, 1 - 3 * (1 - threshold) - slack)
    candidates = connected_components(edges)
    # 2. exact links inside each candidate component
    members = materialize(candidates.join(classes.select("node", "class_id", "weight"), "node"), "jaccard-members")
    found = _sets_of(own.withColumnRenamed("doc_id", "class_id").join(members.hint("merge"), "class_id"), n)
    found = found.where("set = node").dropDuplicates(["node"])
    links = materialize(count_links(blocked(found, block), exact_jaccard, threshold), "jaccard-links")
    n_links = links.groupBy("node").agg(F.sum("n_links").alias("other"))
    exact = connected_components(links.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = component_ids(exact, classes)
    info = classes.select("node", "class_id", "weight").join(n_links, "node", "left").join(named, "node", "left")
    info = info.select(F.col("node").alias("set"), "class_id", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    info = materialize(info, "jaccard-classes")
    own, bare = rows.select("doc_id", "set"), rows.where("set = 0").select("doc_id")  # without words: no class
    out = join_facts(own.where("set <> 0"), info, "set", classes.select(F.col("node").alias("set"), F.col("weight").alias("n")), rows.count())
    out = out.unionByName(bare, allowMissingColumns=True)
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        known(F.col("doc_id")).alias("doc_id"),
        known(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        known(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def op10_jaccard(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))
