"""Vectorised helpers over the bytes of many texts at once (numpy, used inside tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD6E8FEB86659FD93
_POW: dict[str, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POW or len(_POW["up"]) < n:
        size = max(n, 1 << 21)
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, step, np.uint64)
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
    return _POW["up"][:n], _POW["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def groups(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes together (a longer one stands alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offset of each text plus the end."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lens)])


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the index of its text. `inside`: whether a byte belongs to a word."""
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hash(buf, s, e), np.searchsorted(offsets, s, side="right") - 1


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[s:e].

    Eight bytes at a time go through a bijection of 64 bits, so spans of up to eight bytes
    and one length never collide, and no family of longer ones is known to, as there is for
    polynomials modulo 2**64. Spans of over 256 bytes are hashed one by one.
    """
    size = e - s
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    h = mix64(size.astype(np.uint64) * np.uint64(_BASE))
    open_ = np.flatnonzero(size <= 256)
    for k in range(0, 256, 8):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        cut = (8 * np.maximum(8 - size[open_] + k, 0)).astype(np.uint64)  # bits that belong to what comes after
        h[open_] = mix64(h[open_] ^ ((at[s[open_] + k] << cut) >> cut)) * np.uint64(_STEP)
    for i in np.flatnonzero(size > 256):
        h[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]].data, digest_size=8).digest(), "little")
    return mix64(h)


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one text, and the index of the text."""
    if len(h) < n:
        return h[:0], doc[:0]
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = out * np.uint64(_STEP) + h[i : i + m]
    same = doc[:m] == doc[n - 1 :]
    return mix64(out[same]), doc[:m][same]
