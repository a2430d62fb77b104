"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import hash32, materialize, table, word_count

#: Slots per size class of a source; a fixed value, so that results do not depend on the table's size.
SLOTS = 256


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _size_class(size: Column) -> Column:
    """Four classes per doubling of the size, in order, by its leading bits; at most 251."""
    shift = F.char_length(F.bin(size)) - 3
    return F.when(size < 8, size).otherwise(shift * 4 + F.call_function("shiftright", size, shift)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target size of each source.

    `sizes` has a row per source: source, source_size. Sources in code point
    order, null last, weigh `weights` over and over. Together they get `share`
    of all sizes; a source stops at `cap` times its size and what it leaves is
    dealt out again by weight until none is above (water filling: with sources
    ordered by size over weight, all below some point are full and the others
    get one level times their weight). The windows without a partition run over
    one row per source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    own = ranked.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    own = own.withColumn("full", F.col("level") * F.col("weight") >= F.lit(cap) * F.col("source_size"))
    first = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(every)
    own = own.withColumn("open_at", first)
    target = F.when(F.col("open_at").isNull() | (F.col("place") < F.col("open_at.place")), F.lit(cap) * F.col("source_size"))
    return own.select("source", "source_size", "weight", target.otherwise(F.col("open_at.level") * F.col("weight")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, into: str = "mix") -> DataFrame:
    """Adds to `docs` a struct column `into`: size (words), source_size, target, copies (how often the mix takes the row) and taken (words).

    `docs` needs doc_id, source and text. All its columns are kept as they are, whatever
    their names (one named as `into` is replaced; names that begin with _cw_ are taken).

    Every document of a source is expected target / source_size times. Documents
    of a source stand in a fixed order: by class of size, then slot (a hash of doc_id), size,
    doc_id and a hash of the text. The prefix sum of expected copies after the k-th is k times that
    ratio, so it is formed from whole counts: documents in earlier slots of the
    source plus the row number in the slot. With one random offset per source a
    document is emitted once per integer crossed. The number of slots is fixed, so that a
    document's copies depend on no other source and on no size of the table; slots make a
    hot source, or one size that many copies share, many groups, and only counts per
    (source, class, slot) are gathered.

    Null source: a source of its own, last. Null text: size 0. Null doc_id: its
    slot goes by the text. Repeated rows count as rows; which of equal rows is taken
    makes no difference. Empty table: empty.
    """
    docs = docs.drop(into)
    text = F.col("text").cast("string")
    by_id = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    keyed = docs.withColumns({"_cw_size": word_count(text), "_cw_tie": F.xxhash64(text), "_cw_src": _key(F.col("source")), "_cw_spread": hash32(by_id) % SLOTS})
    # a key that cannot be null: else Spark counts the words once more for a null check before the join
    keyed = keyed.withColumn("_cw_slot", F.coalesce((300 - _size_class(F.col("_cw_size"))) * SLOTS + F.col("_cw_spread"), F.lit(0)))
    counts = keyed.groupBy("_cw_src", "_cw_slot").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("_cw_size").alias("size"))
    counts = materialize(counts, "mix-counts")
    targets = source_targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("_cw_src").orderBy("_cw_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_cw_src", "_cw_slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_cw_base"))
    targets = targets.select(
        _key(F.col("source")).alias("_cw_src"),
        F.col("source_size").alias("_cw_source_size"),
        F.col("target").alias("_cw_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_cw_ratio"),
        (hash32(F.concat(F.lit(f"{seed}|"), _key(F.col("source")))) / F.lit(4294967296.0)).alias("_cw_offset"),
    )
    base = base.join(targets, "_cw_src")
    inside = Window.partitionBy("_cw_src", "_cw_slot").orderBy(F.col("_cw_size").desc(), "doc_id", "_cw_tie")
    placed = keyed.withColumn("_cw_k", F.row_number().over(inside)).join(base, ["_cw_src", "_cw_slot"])
    upto = lambda k: F.floor(k * F.col("_cw_ratio") + F.col("_cw_offset"))
    at = F.col("_cw_base") + F.col("_cw_k")
    copies = (upto(at) - upto(at - 1)).cast("long")
    out = placed.withColumn("_cw_copies", copies)
    added = F.struct(F.col("_cw_size").alias("size"), F.col("_cw_source_size").alias("source_size"), F.col("_cw_target").alias("target"), F.col("_cw_copies").alias("copies"), (F.col("_cw_copies") * F.col("_cw_size")).alias("taken"))
    return out.select(*docs.columns, added.alias(into))


def op4_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


SQL_OP4 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         coalesce('s' || source, 'n') src,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 't' || md5(coalesce(text, '')))), 1, 8))::bigint % 256 spread
  from documents),
classed as (select *, case when size < 8 then size else (length(bin(size)) - 3) * 4 + (size >> (length(bin(size)) - 3)) end cls from sized),
sources as (select source, src, sum(size)::bigint source_size from sized group by all),
ranked as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double weight,
                  row_number() over (order by source nulls last) rank from sources),
filled as (select *, row_number() over f place,
                  (1.5::double * sum(source_size) over ()::double
                   - 2.0::double * coalesce(sum(source_size) over (f rows between unbounded preceding and 1 preceding), 0)::double)
                  / (sum(weight) over () - coalesce(sum(weight) over (f rows between unbounded preceding and 1 preceding), 0.0::double)) lvl
           from ranked window f as (order by source_size / weight, rank)),
open_at as (select min(place) place, arg_min(lvl, place) lvl from filled where lvl * weight < 2.0::double * source_size),
targets as (select src, source_size,
                   case when o.place is null or f.place < o.place then 2.0::double * source_size else o.lvl * weight end::double target
            from filled f cross join open_at o),
offsets as (select *, case when source_size > 0 then target / source_size else 0.0::double end ratio,
                   ('0x' || substr(md5('17|' || src), 1, 8))::bigint / 4294967296.0::double u from targets),
placed as (select s.*, row_number() over (partition by src order by cls desc, spread, size desc, doc_id) k from classed s)
select doc_id, size, source_size, target,
       (floor(k * ratio + u) - floor((k - 1) * ratio + u))::bigint * size taken
from placed join offsets using (src)
"""
