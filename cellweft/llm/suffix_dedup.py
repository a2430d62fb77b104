"""Removal of byte strings that also stand in an earlier document, by a sparse suffix array.

Of all suffixes of all texts only those are sorted that start at a sampled place: in
each window of `length` bytes, the place whose `lead` bytes have the smallest
fingerprint. Equal windows sample equal places, so no repeat is lost. Sampled
suffixes are dealt to ranges by splitters over the fingerprint of their leading
bytes, and each range sorts its suffixes and compares neighbours. They are kept in
packed arrays, one per range and chunk of texts, and a chunk sends equal suffixes
once: a passage in a third of all texts is one entry per chunk.

A sampled suffix stands for the run of windows that sampled it. A run that also stands
in an earlier document is decided at once. What is left are the first documents of the
runs; where a leading string has several runs, windows may be equal though their runs are not. Such windows agree
for half of their other bytes on the left or on the right of the leading string, so a
run also carries 15 bits of either half, and only windows on a side that another run
shares are sorted in a second round, as suffixes of `length` bytes. Bytes are compared through digests: 64 bits of the
leading string with 32 bits of the run and those of its halves; 64 bits of a window with 32 bits of its leading string.

Rows shuffled: one per chunk and range that have an entry in common, so at most as many as there
are entries (one per 18 bytes of text).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm import textvec as tv
from cellweft.llm.common import materialize, table

NO_ID = 2**63 - 1  # stands for a null doc_id inside: later than all others
_PLACE_BITS = 24
#: What is known of a run: 0 nothing more, 1 it stands in an earlier document, else the sides on which another run has the same half.
_LEFT, _RIGHT = 2, 4
#: Windows sampled at a time, to bound memory; a run that goes on is two runs then, which the second round bears.
_STEP = 1 << 19


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x.nbytes for x in arrays]], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(x.tobytes() for x in arrays), 1)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types), 8), 8 * (len(types) + 1), []
    for t, n in zip(types, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def _chunks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.text_column(batch, "text")
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in tv.groups(texts, most):
                lens = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
                data = zstandard.compress(b"".join(texts[a:b]), 3)
                yield pa.RecordBatch.from_arrays([pa.array([secrets.randbits(62)]), pa.array([int(lens.sum())]), pa.array([_pack(ids[a:b], lens)]), pa.array([data])], ["chunk", "bytes", "docs", "data"])

    return run


class _Runs:
    """Sampled suffixes of a chunk: runs of windows with the same sampled place."""

    def __init__(self, docs: bytes, data: bytes, length: int, lead: int):
        self.ids, lens = _unpack(docs, "i8", "i8")
        self.buf = np.frombuffer(zstandard.decompress(data) if data else b"", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        self.length = length
        self.prefix = tv.prefix_hash(self.buf)
        first = []
        for a in range(0, max(len(self.buf) - length + 1, 0), _STEP):
            first.append(self._sampled(a, min(a + _STEP, len(self.buf) - length + 1), lead))
        self.lo, self.hi, place = (np.concatenate([x[i] for x in first]) if first else np.zeros(0, np.int64) for i in range(3))
        self.doc = np.searchsorted(self.offsets, self.lo, side="right") - 1
        self.key = tv.mix64(self.hash(place, place + lead) ^ np.uint64(0x27D4EB2F165667C5))
        # windows up to here have half of their other bytes to the left of the leading string, later ones to the right
        half = (length - lead) // 2
        self.mid = place - half
        self.left = self._half(self.mid, place + lead, self.lo <= self.mid)
        self.right = self._half(place, self.mid + 1 + length, self.hi > self.mid)
        self.run = tv.mix64(self.hash(self.lo, self.hi + length) + (place - self.lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = tv.powers(len(self.buf) + 1)
        return tv.mix64((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def _half(self, start: np.ndarray, end: np.ndarray, there: np.ndarray) -> np.ndarray:
        """15 bits of the bytes on one side, and one that is set; 0 for a run without windows there."""
        out = np.zeros(len(start), np.uint16)
        out[there] = self.hash(start[there], end[there]) >> np.uint64(48) | np.uint64(1)
        return out

    def _sampled(self, a: int, b: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window and place of each run of the windows that start in [a, b)."""
        n = b - a + self.length - lead  # places that these windows look at
        _, down = tv.powers(len(self.buf) + 1)
        h = tv.mix64((self.prefix[a + lead : a + lead + n] - self.prefix[a : a + n]) * down[a : a + n])
        h = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        span, w = self.length - lead + 1, 1
        while 2 * w <= span:
            h = np.minimum(h[:-w], h[w:])
            w *= 2
        if span > w:
            h = np.minimum(h[: len(h) - (span - w)], h[span - w :])
        place = (h[: b - a] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        start = np.arange(a, b)
        inside = start + self.length <= self.offsets[np.searchsorted(self.offsets, start, side="right")]
        start, place = start[inside], place[inside] + a
        if not len(start):
            return start, start, start
        cut = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        s, e = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
        return start[s], start[e], place[s]

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs in order of their leading string: key, run with its halves, first document, and the index per row."""
        run = (self.run & np.uint64(0xFFFFFFFF)) | (self.left.astype(np.uint64) << np.uint64(32)) | (self.right.astype(np.uint64) << np.uint64(48))
        return _firsts(self.key, run, self.ids[self.doc])

    def windows(self, of: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash, check and document of each window of the runs `of`, on the sides that `state` names."""
        lo = np.where(state & _LEFT, self.lo[of], np.maximum(self.lo[of], self.mid[of] + 1))
        n = np.where(state & _RIGHT, self.hi[of], np.minimum(self.hi[of], self.mid[of])) - lo + 1
        start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h = self.hash(start, start + self.length)
        check = np.repeat(self.key[of] & np.uint64(0xFFFFFFFF), n)
        return start, tv.mix64(h ^ np.uint64(0x165667B19E3779F9)), check, np.repeat(self.ids[self.doc[of]], n)


def _firsts(key: np.ndarray, check: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal (key, check) in order: both, the smallest id, and the group of each row."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    if not len(k):
        return k, c, ids[order], np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
    group = np.empty(len(k), np.int64)
    group[order] = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(k)]])))
    return k[start], c[start], np.minimum.reduceat(ids[order], start), group


def _shared(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether another row has the same (key, half); rows with half 0 share nothing."""
    order = np.lexsort((half, key))
    k, h = key[order], half[order]
    same = (k[1:] == k[:-1]) & (h[1:] == h[:-1]) & (h[1:] != 0)
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Range of sorted keys; splitters cut the 64-bit fingerprints evenly, as a sample of them would."""
    return np.searchsorted(key, (np.arange(ranges + 1, dtype=np.float64) / ranges * 2.0**64).clip(0, 2.0**64 - 2048).astype(np.uint64)[1:-1]) if ranges > 1 else np.zeros(0, np.int64)


def _dealt(chunk: int, ranges: int, key: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    cuts = [0, *_range_of(key, ranges).tolist(), len(key)]
    full = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
    of = lambda x, i: x[cuts[i] : cuts[i + 1]]
    parts = [_pack(_gaps(of(key, i)), _planes(of(ids, i)), *[of(c, i) for c in columns]) for i in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(parts, pa.binary())], ["range", "chunk", "payload"])


def _planes(x: np.ndarray) -> np.ndarray:
    """64-bit values byte by byte: all first bytes, all second bytes and so on, which packs well if the high ones are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).ravel() if len(x) else np.zeros(0, np.uint8)


def _from_planes(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel() if len(planes) else np.zeros(0, kind)


def _gaps(key: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, packed by bytes."""
    return _planes(np.diff(key, prepend=np.uint64(0)))


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_from_planes(planes, "u8"), dtype=np.uint64)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch one at a time: chunks are large, so no more than one is held unpacked."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _emit_runs(length: int, lead: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs, data in _rows(batch, "chunk", "docs", "data"):
                key, run_, low, _ = _Runs(docs, data, length, lead).firsts()
                yield _dealt(chunk, ranges, key, low, *[(run_ >> np.uint64(by)).astype(kind) for by, kind in ((0, np.uint32), (32, np.uint16), (48, np.uint16))])

    return run


def _answer_runs(key: tuple, group: pa.Table) -> pa.Table:
    """Per chunk and run: 0 nothing earlier outside the chunk, 1 the run stands in an earlier document, else look at the windows of its first document on these sides."""
    parts = [_unpack(x, "u1", "u1", "u4", "u2", "u2") for x in group.column("payload").to_pylist()]
    keys, own = [_keys(p[0]) for p in parts], np.concatenate([_from_planes(p[1], "i8") for p in parts])
    run = np.concatenate([p[2].astype(np.uint64) | (p[3].astype(np.uint64) << np.uint64(32)) | (p[4].astype(np.uint64) << np.uint64(48)) for p in parts])
    k, run, low, at = _firsts(np.concatenate(keys), run, own)
    sides = sum(bit * _shared(k, (run >> np.uint64(by)).astype(np.uint16)) for bit, by in ((_LEFT, 32), (_RIGHT, 48)))
    state = np.where(low[at] < own, 1, sides[at]).astype(np.uint8)
    return _answers(key, group, [len(k) for k in keys], state, low[at])


def _answers(key: tuple, group: pa.Table, sizes: list[int], state: np.ndarray, low: np.ndarray) -> pa.Table:
    out, a = [], 0
    for n in sizes:
        s = state[a : a + n]
        out.append(_pack(s, low[a : a + n][s == 1]))
        a += n
    return pa.table({"chunk": group.column("chunk"), "range": pa.array([key[0].as_py()] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})


def _answer_windows(key: tuple, group: pa.Table) -> pa.Table:
    parts = [_unpack(x, "u1", "u1", "u4") for x in group.column("payload").to_pylist()]
    keys, own = [_keys(p[0]) for p in parts], np.concatenate([_from_planes(p[1], "i8") for p in parts])
    _, _, low, at = _firsts(np.concatenate(keys), np.concatenate([p[2] for p in parts]), own)
    return _answers(key, group, [len(x) for x in keys], (low[at] < own).astype(np.uint8), low[at])


def _read_answers(rows: list[dict] | None, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and earliest document of the entries of a chunk, over all ranges in order; `own` is the earliest within the chunk."""
    state, low = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for row in sorted(rows or [], key=lambda x: x["range"]):
        s, d = _unpack(row["payload"], "u1", "i8")
        state.append(s), low.append(d)
    first, state = own.copy(), np.concatenate(state)
    first[state == 1] = np.concatenate(low)
    return state, first


def _open_windows(r: _Runs, rows: list[dict] | None):
    """The earliest document known of each run, and the windows of those that are not decided."""
    _, _, own, group = r.firsts()
    state, low = _read_answers(rows, own)
    of = np.flatnonzero((state[group] > 1) & (r.ids[r.doc] == own[group]))
    return low[group], r.windows(of, state[group[of]])


def _emit_windows(length: int, lead: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs, data, known in _rows(batch, "chunk", "docs", "data", "runs"):
                _, (_, h, check, ids) = _open_windows(_Runs(docs, data, length, lead), known)
                key, check, low, _ = _firsts(h, check, ids)
                yield _dealt(chunk, ranges, key, low, check.astype(np.uint32))

    return run


def _emit_result(length: int, lead: int, keep_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, data, known, seen in _rows(batch, "docs", "data", "runs", "windows"):
                r = _Runs(docs, data, length, lead)
                low, (start, h, check, ids) = _open_windows(r, known)
                _, _, own, group = _firsts(h, check, ids)
                whole, one = low < r.ids[r.doc], _read_answers(seen, own)[1][group] < ids
                edge = np.zeros(len(r.buf) + 1, np.int32)
                np.add.at(edge, np.concatenate([r.lo[whole], start[one]]), 1)
                np.add.at(edge, np.concatenate([r.hi[whole], start[one]]) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                # a run of removed bytes ends with its document
                begins = gone & ~np.concatenate([[False], gone[:-1]])
                first = r.offsets[:-1][np.diff(r.offsets) > 0]
                begins[first] = gone[first]
                count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[r.offsets])
                lens, removed, spans = np.diff(r.offsets), count(gone), count(begins)
                kept = [r.buf[s:e] if not n else r.buf[s:e][~gone[s:e]] for s, e, n in zip(r.offsets[:-1], r.offsets[1:], removed, strict=True)]
                sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r.ids, lens, removed.astype(np.int64), spans.astype(np.int64))] + [pa.array(sha, pa.string())] + [pa.array([x.tobytes() for x in kept], pa.binary())] * keep_text, names)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, lead: int = 16, chunk_bytes: int = 2 << 20, range_bytes: int = 16 << 20, keep_text: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for.

    Removed is each byte of a text that lies in a string of `length` bytes that also
    starts in a document with a smaller doc_id, judged on the texts as they came.
    n_spans: maximal removed runs; kept_sha256: of the remaining bytes.

    Null and empty texts: nothing to remove. Null doc_id: later than all others,
    and not than each other. Rows of one doc_id do not remove from each other. Empty
    table: empty. Columns other than doc_id and text are not read. A text is read whole, with some 60 times
    its length of memory if it is longer than a chunk.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = materialize(own.mapInArrow(_chunks(chunk_bytes), "chunk long, bytes long, docs binary, data binary"), "suffix-chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-total // range_bytes))
    packed = "range int, chunk long, payload binary"
    answer = "chunk long, range int, payload binary"
    by_chunk = lambda df, name: df.groupBy("chunk").agg(F.collect_list(F.struct("range", "payload")).alias(name))  # noqa: E731  one row per range
    runs = chunks.mapInArrow(_emit_runs(length, lead, ranges), packed).groupBy("range").applyInArrow(_answer_runs, answer)
    runs = materialize(runs, "suffix-runs")
    with_runs = chunks.join(by_chunk(runs, "runs"), "chunk", "left")
    # not written, so that the chunks, which are shuffled to their runs, are so once for both uses
    windows = with_runs.mapInArrow(_emit_windows(length, lead, ranges), packed).groupBy("range").applyInArrow(_answer_windows, answer)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = with_runs.join(by_chunk(windows, "windows"), "chunk", "left").mapInArrow(_emit_result(length, lead, keep_text), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
