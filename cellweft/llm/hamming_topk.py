"""Exact nearest binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments. Two codes at distance d agree within
floor(d / m) bits in at least one of m segments. The segments' radii grow one by one, and
only for the queries whose k-th verified distance is not covered yet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import materialize, table

BITS = 64


def sign_code(embedding: Column, bits: int = BITS) -> Column:
    """Code whose bit i says whether component i is above zero (null, missing or NaN: 0)."""
    one = lambda i: F.when(F.nanvl(F.coalesce(F.get(embedding, F.lit(i)).cast("double"), F.lit(0.0)), F.lit(0.0)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    out = one(0)
    for i in range(1, bits):
        out = out.bitwiseOR(one(i))
    return F.when(embedding.isNotNull(), out)


def segments(m: int) -> list[tuple[int, int]]:
    """First bit and width of m segments that differ by one bit at most."""
    cuts = [i * BITS // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def flips(width: Column, radius: int) -> Column:
    """Array of the differences of exactly `radius` bits in a segment of `width` bits."""
    out = F.array(F.struct(F.lit(0).alias("mask"), F.lit(0).alias("low")))
    for _ in range(radius):
        further = lambda x: F.when(x["low"] < width, F.sequence(x["low"], width - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        with_bit = lambda x, b: F.struct(x["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1), b)).alias("mask"), (b + 1).alias("low"))
        out = F.flatten(F.transform(out, lambda x: F.transform(further(x), lambda b: with_bit(x, b))))  # noqa: B023
    return F.transform(out, lambda x: x["mask"])


def probes_of(m: int, upto: int, after: int = -1) -> int:
    """Probes of the steps after `after` up to `upto`; step t probes segment t % m to radius t // m."""
    widths = [w for _, w in segments(m)]
    return sum(math.comb(widths[t % m], t // m) for t in range(after + 1, upto + 1))


def segments_for(n: int, k: int) -> int:
    """Number of segments, from 3 (a segment is an int) to 16, for which a query's probes and the entries they meet are fewest.

    Planned for n codes whose bits are even and independent, where the k-th is
    expected at the distance within which k of n codes lie.
    """
    within = (sum(math.comb(BITS, i) for i in range(d + 1)) * n / 2**BITS for d in range(BITS + 1))
    kth = next((d for d, x in enumerate(within) if x >= k), BITS)
    return min(range(3, 17), key=lambda m: probes_of(m, kth) * (1 + n / 2 ** (BITS / m)))


def hamming_topk(codes: DataFrame, queries: DataFrame, k: int = 10, m: int | None = None, probes_at_once: int = 300_000) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, distance: the k nearest codes of each query, ties by vec_id.

    `codes` has vec_id and code (long), `queries` query_id and code. A query also
    meets its own row if that is among the codes. Null codes or ids take no part; repeated
    rows count as rows. Fewer than k codes: all of them.

    Equal codes are one entry that keeps its k smallest ids, which is all that a
    query can use of them; a code that a third of the rows share is one row in
    every index table. Step t probes segment t % m with all values that differ in t // m
    bits from the query's; after step t all codes within distance t have been met, as one
    further away in every segment than probed differs in t + 1 bits or more. A query stops
    at the step of its k-th verified distance, and entries beyond that distance are left in the
    join. The first round takes steps for some 8 k entries a query. Each later round takes steps until it has as many probes a query as
    were made before, or `probes_at_once` in all. By default m is planned by
    `segments_for`; the result is exact with any. Empty tables: no rows. Columns other
    than those named are not read.
    """
    by_code = Window.partitionBy("code").orderBy("vec_id")
    top = codes.where("code is not null and vec_id is not null").select("code", "vec_id").withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k)
    entries = materialize(top.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "codes")
    total = entries.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    n = entries.count()
    m = m or segments_for(n, k)
    parts = segments(m)
    keys = lambda code, name: F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(code, a, w).alias(name)) for i, (a, w) in enumerate(parts)]))
    index = entries.select(F.col("code").alias("other"), F.size("ids").alias("n"), keys(F.col("code"), "val").alias("key")).select("other", "n", "key.*")
    # equal query codes ask once
    asked = queries.where("code is not null and query_id is not null").select("query_id", "code")
    open_q = materialize(asked.select("code", F.lit(None).cast("int").alias("kth")).distinct(), "queries")
    best, done, asking, last = None, None, open_q.count(), -1
    while True:
        room = max(probes_of(m, last), probes_at_once // max(asking, 200)) if last >= 0 else 8 * k * 2 ** (BITS / m) / max(n, 1)
        step = last + 1
        while step < BITS and probes_of(m, step + 1, last) <= room:
            step += 1
        steps = open_q.withColumn("step", F.explode(F.sequence(F.lit(last + 1), F.lit(step)))).where(F.col("kth").isNull() | (F.col("step") <= F.col("kth")))
        seg, width = F.col("step") % m, F.element_at(F.array(*[F.lit(w) for _, w in parts]), F.col("step") % m + 1)
        own = F.element_at(F.array(*[_segment(F.col("code"), a, w) for a, w in parts]), F.col("step") % m + 1)
        masks = F.coalesce(*[F.when(F.floor(F.col("step") / m) == r, flips(width, r)) for r in range((last + 1) // m, step // m + 1)])
        probes = steps.select("code", "kth", seg.alias("seg"), own.alias("own"), F.explode(masks).alias("mask")).select("code", "kth", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val"))
        # Spark takes exploded rows for as few as their source and would broadcast them
        distance = F.bit_count(F.col("code").bitwiseXOR(F.col("other")))
        meet = (probes["seg"] == index["seg"]) & (probes["val"] == index["val"]) & (distance <= F.coalesce("kth", F.lit(BITS)))
        hits = probes.hint("merge").join(index, meet).select("code", "other", "n", distance.cast("int").alias("distance"))
        hits = (hits if best is None else best.unionByName(hits)).distinct()
        # entries that can be among the first k ids: fewer than k ids stand before them
        before = Window.partitionBy("code").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        near = hits.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("ahead") < k).drop("ahead")
        near = materialize(near, "nearest")
        found = near.groupBy("code").agg(F.sum("n").alias("n"), F.max("distance").alias("kth")).where(F.col("n") >= min(k, total)).select("code", "kth")
        sure = found.where(F.col("kth") <= step).select("code") if step < BITS else open_q.select("code")
        out = near.join(sure, "code", "left_semi").select("code", "other", "distance")
        done = out if done is None else done.unionByName(out)
        open_q = materialize(open_q.select("code").join(sure, "code", "left_anti").join(found, "code", "left"), "queries")
        asking, last = open_q.count(), step
        if not asking:
            break
        best = near.join(open_q.select("code"), "code", "left_semi").select("code", "other", "n", "distance")
    ids = done.hint("merge").join(entries.select(F.col("code").alias("other"), "ids"), "other").select("code", "distance", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))
    firsts = ids.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(firsts, "code").select("query_id", "rank", "vec_id", "distance")


def op7_hamming_topk(spark, sf_dir):
    codes = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return hamming_topk(codes, codes.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


SQL_OP7 = """
with codes as (
  select vec_id, list_transform(range(64), lambda i: case when embedding[i + 1] > 0 and not isnan(embedding[i + 1]) then 1 else 0 end) bits
  from embeddings where embedding is not null),
pairs as (
  select q.vec_id query_id, c.vec_id,
         list_sum(list_transform(range(64), lambda i: case when q.bits[i + 1] <> c.bits[i + 1] then 1 else 0 end))::int distance
  from codes q, codes c where q.vec_id % 100 = 0)
select query_id, rank::int rank, vec_id, distance
from (select *, row_number() over (partition by query_id order by distance, vec_id) rank from pairs) where rank <= 10
"""
