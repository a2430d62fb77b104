"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are
zero, so cuts depend on the bytes just before them and come back soon after an
insertion. Chunks are compared by a 128-bit digest, and all but the first of equal
chunks are repeats.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm import textvec as tv
from cellweft.llm.common import materialize, table

NO_ID = 2**63 - 1  # stands for a null doc_id inside: later than all others
#: Default sizes: a chunk has LEAST to MOST bytes, about LEAST + 2**BITS.
BITS, LEAST, MOST = 5, 32, 256
#: Neighbouring repeats are removed if together they have this many bytes: more than one common phrase.
LEAST_RUN = 80
#: One 32-bit value per byte value; any fixed random-looking table will do.
GEAR = (tv.mix64(np.arange(256, dtype=np.uint64) + np.uint64(977)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = (h << 1) + GEAR[byte] in 32 bits, so of the last 32 bytes; by doubling."""
    h = GEAR[buf]
    for s in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[s:] += h[:-s] << np.uint32(s)
        h = nxt
    return h


def cut_points(ends: np.ndarray, start: int, stop: int, least: int, most: int) -> list[int]:
    """Chunk ends in [start, stop): the next candidate at least `least` on, at most `most` on."""
    out, at, i, n = [], start, 0, len(ends)
    ends = ends.tolist()
    while stop - at > least:
        low = at + least
        while i < n and ends[i] < low:
            i += 1
        at = min(ends[i] if i < n else stop, at + most, stop)
        out.append(at)
    if at < stop:
        out.append(stop)
    return out


def _emit(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = tv.text_column(batch, "text"), batch.column(0).to_pylist()
            for a, b in tv.groups(texts):
                buf, offsets = tv.joined(texts[a:b])
                ends = np.flatnonzero(gear(buf) >> np.uint32(32 - bits) == 0) + 1
                per = np.searchsorted(ends, offsets, side="right")
                row0 = secrets.randbits(62)
                whole = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) for t in texts[a:b]]
                start, stop, owner = [], [], []
                for i in range(b - a):
                    s, e = int(offsets[i]), int(offsets[i + 1])
                    cuts = cut_points(ends[per[i] : per[i + 1]], s, e, least, most) or [e]
                    start += [s, *cuts[:-1]]
                    stop += cuts
                    owner += [i] * len(cuts)
                data = buf.tobytes()
                digest = [hashlib.blake2b(data[s:e], digest_size=16).digest() if e > s else None for s, e in zip(start, stop, strict=True)]
                owner, s, e = np.array(owner), np.array(start), np.array(stop)
                doc = np.array(ids[a:b], np.int64)[owner]
                cols = [pa.array(doc), pa.array(np.array(whole, np.int64)[owner]), pa.array(row0 + owner), pa.array(s - offsets[owner]), pa.array(e - s), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "row", "start", "length", "digest"])

    return run


def chunk(docs: DataFrame, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Rows doc_id, text_hash, row (one number per row of `docs`), start, length (bytes), digest; an empty text has one empty chunk."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_emit(bits, least, most), "doc_id long, text_hash long, row long, start long, length long, digest binary")


def substring_dedup(docs: DataFrame, bits: int = BITS, least: int = LEAST, most: int = MOST, least_run: int = LEAST_RUN) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_chunks, n_repeats, n_removed, spans.

    A chunk is a repeat if an equal one stands earlier: by doc_id, then (rows of one
    doc_id) by a hash of the text, then place. Equal rows have no order, and any one of them
    keeps its chunks.
    Repeats that follow on each other count if they have `least_run` bytes together, or are
    the whole text; a shorter one is a phrase that ordinary texts share. n_removed: bytes
    of the repeats that count; spans: their places as array of (start, length)
    in bytes of the UTF-8 text, neighbours apart.

    Chunks have `least` to `most` bytes (the last of a text may be shorter), about
    least + 2**bits. Only digests that occur more than once are joined back. Null and
    empty texts: no bytes, no repeats. Null doc_id: after all others. Of repeated rows
    all but one are repeats. Empty table: empty. Columns other than doc_id and text are not
    read. Texts are read whole; memory is some 20 times the longest text.
    """
    chunks = materialize(chunk(docs, bits, least, most), "chunks")
    first = chunks.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "row", "start")).alias("first"))
    first = first.where("n > 1").select("digest", "first")
    repeats = chunks.select("digest", F.struct("doc_id", "text_hash", "row", "start").alias("own"), "length").join(first, "digest").where("own <> first")
    own = repeats.select("own.row", "own.start", "length")
    place = Window.partitionBy("row").orderBy("start")
    apart = F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("length")).over(place), F.lit(-1))
    own = own.withColumn("island", F.sum(apart.cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("long", F.sum("length").over(Window.partitionBy("row", "island")) >= least_run)
    span, at = F.struct("start", "length"), lambda c: F.sort_array(F.collect_list(c))
    per_row = own.groupBy("row").agg(F.sum("length").alias("bytes"), at(span).alias("every"), at(F.when(F.col("long"), span)).alias("some"))
    rows = chunks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("n_bytes"), F.count("digest").alias("n_chunks"))
    nothing = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    out = rows.join(per_row, "row", "left").withColumn("spans", F.coalesce(F.when(F.col("bytes") == F.col("n_bytes"), F.col("every")).otherwise(F.col("some")), nothing))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_chunks", F.size("spans").cast("long").alias("n_repeats"), removed.alias("n_removed"), "spans")


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), (s["start"] + s["length"]).cast("string"))), ",")
    return out.select("doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", listed.alias("removed_spans"))
