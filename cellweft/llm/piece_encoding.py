"""Encoding into sentence pieces that keeps the place of every piece in the original bytes.

A text is normalised by the model's compiled character map: at each place the longest
prefix that the map knows is replaced, every other character is copied. Beside each
normalised byte stands the byte of the original from which it came. White space is
folded, marked and prefixed as the model asks, in the same two arrays. The normalised text
is then cut into pieces, and the bounds of each piece are read from that alignment.

Pieces of a BPE vocabulary in which the space mark stands only in front never cross
from a word to the mark after it. So a long text is segmented in windows that end before a
mark. The segmentation of a window is the library's, with its normaliser switched off.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import table

SPACE = "▁"  # the mark that stands for a space
_MARK = SPACE.encode()
WINDOW = 1 << 16  # normalised characters that are segmented at once


class CharMap:
    """The compiled character map of a model: a double array of prefixes and their replacements.

    The blob holds the array's size in bytes, the array of 32-bit units, and the
    replacements, each ended by a zero byte. A unit has the label in its low 8 bits, a
    flag for a value in bit 8, and the offset of its children above.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]
        self._starts: dict[str, bool] = {}

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[start:], and its replacement."""
        if not self.units:
            return None
        units, at, found = self.units, self._children(self.units[0]), None
        for i in range(start, len(data)):
            at ^= data[i]
            if at >= len(units) or units[at] & 0x800000FF != data[i]:
                break
            unit = units[at]
            at ^= self._children(unit)
            if unit & 0x100:
                found = (i + 1 - start, units[at] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.values[found[1] : self.values.index(b"\0", found[1])]

    def begins(self, char: str) -> bool:
        """Whether some known prefix begins with this character."""
        known = self._starts.get(char)
        if known is None:
            units, at, known = self.units, self._children(self.units[0]) if self.units else 0, bool(self.units)
            for c in char.encode():
                if not known:
                    break
                at ^= c
                known = at < len(units) and units[at] & 0x800000FF == c
                at ^= self._children(units[at]) if known else 0
            self._starts[char] = known
        return known


class PieceEncoder:
    """A sentencepiece model with alignment. Models with user-defined symbols are refused."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            blob = f.read()
        model = proto.ModelProto.FromString(blob)
        kinds = proto.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined symbols or trailing space marks are not supported")
        self.spec = proto.NormalizerSpec.FromString(model.normalizer_spec.SerializeToString())
        self.map = CharMap(self.spec.precompiled_charsmap)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model.normalizer_spec.CopyFrom(proto.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.byte = {i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.width = np.array([1 if i in self.byte else len(p.piece.encode()) for i, p in enumerate(model.pieces)])
        self.unknown = self.plain.unk_id()
        self.mark = self.plain.piece_to_id(SPACE)
        self.decimal = [str(i) for i in range(len(model.pieces))]
        # where windows may end: no piece goes from another character on to a mark
        normal = (p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED))
        apart = model.trainer_spec.model_type == proto.TrainerSpec.BPE and self.mark != self.unknown
        self.cut = re.compile(f"[^{SPACE}](?={SPACE})") if apart and not any(SPACE in p.lstrip(SPACE) for p in normal) else None
        # what a piece decodes to wherever it stands: all but control and unknown ones, and bytes that are no character alone
        self.surface = [chr(int(p.piece[3:5], 16)) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ") for p in model.pieces]
        self.other = {i for i, p in enumerate(model.pieces) if p.type not in (kinds.NORMAL, kinds.BYTE) or (p.type == kinds.BYTE and ord(self.surface[i]) > 0x7F)}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each (and the end) the original byte it came from."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        place = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        inner = np.zeros(len(data), bool)  # behind the first byte of a replacement
        risky = [c for c in set(text) if self.map.begins(c)] if self.map.units else []
        void = len(raw)  # the first place whose replacement is empty
        if risky:
            data, place, inner, void = self._replace(text, raw, risky)
        end, first = len(raw), 0
        blank = data == 0x20
        if self.spec.remove_extra_whitespaces:
            # a unit of the source loses the spaces it begins with if what came before ended with one
            before = np.concatenate([[True], blank[:-1]])[: len(data)]
            drop = blank & before & ~inner
            for i in np.flatnonzero(blank & inner):  # the same for replacements that begin with several spaces
                drop[i] = drop[i - 1]
            while first < len(data) and blank[first] and not (first + 1 < len(data) and inner[first + 1]):
                first += 1
            if first == len(data):
                return b"", np.zeros(1, np.int64) + end
            start = min(int(place[first]), void)
            data, place, blank = data[~drop], place[~drop], blank[~drop]
        else:
            start = 0
        if not len(raw):
            return b"", np.zeros(1, np.int64)
        if self.spec.escape_whitespaces:
            width = np.where(blank, len(_MARK), 1)
            at = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.uint8)
            out[at] = data
            for i, c in enumerate(_MARK):
                out[at[blank] + i] = c
            data, place = out, np.repeat(place, width)
        mark = _MARK if self.spec.escape_whitespaces else b" "
        done = data.tobytes()
        if self.spec.add_dummy_prefix:
            done, place = mark + done, np.concatenate([np.full(len(mark), start), place])
        if self.spec.remove_extra_whitespaces:
            size = len(done)
            while done.endswith(mark, 0, size):
                size -= len(mark)
                end = int(place[size])
            done, place = done[:size], place[:size]
        return done, np.append(place, end)

    def _replace(self, text: str, raw: bytes, risky: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The text after the character map: bytes, places, which bytes are not the first of a replacement, the first place replaced by nothing."""
        parts, places, inner, done, void = [], [], [], 0, len(raw)
        starts = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
        own = np.maximum.accumulate(np.where(starts, np.arange(len(raw)), 0))
        byte_of = np.append(np.flatnonzero(starts), len(raw))
        for m in re.finditer("[" + "".join(map(re.escape, risky)) + "]", text):
            at = int(byte_of[m.start()])
            if at < done:
                continue
            hit = self.map.longest(raw, at)
            if hit is None:
                continue
            parts.append(np.frombuffer(raw[done:at], np.uint8))
            places.append(own[done:at])
            inner.append(np.zeros(at - done, bool))
            size, new = hit
            parts.append(np.frombuffer(new, np.uint8))
            places.append(np.full(len(new), at))
            inner.append(np.arange(len(new)) > 0)
            void = void if new else min(void, at)
            done = at + size
        parts.append(np.frombuffer(raw[done:], np.uint8))
        places.append(own[done:])
        inner.append(np.zeros(len(raw) - done, bool))
        return np.concatenate(parts), np.concatenate(places), np.concatenate(inner), void

    def _segment(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids of a normalised text and the bytes that each piece takes of it."""
        ids = self.plain.encode(text)
        return self._with_unknown(text) if self.unknown in ids else (ids, self.width[ids])

    def _with_unknown(self, text: str) -> tuple[list[int], np.ndarray]:
        """As the library cuts it; runs of unknown characters are one piece, of any width."""
        found = self.plain.encode(text, return_type="proto").pieces
        return [p.id for p in found], np.array([1 if p.id in self.byte else p.end - p.begin for p in found], np.int64)

    def windows(self, text: str) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Ids, starts and ends (original bytes) of the pieces, a window at a time."""
        norm, place = self.normalise(text)
        norm = norm.decode()
        at = done = 0
        while at < len(norm):
            cut = self.cut.search(norm, at + WINDOW) if self.cut else None
            part = norm[at : cut.end() if cut else len(norm)]
            ids, width = self._segment(part)
            bounds = done + np.concatenate([[0], np.cumsum(width)])
            yield ids, place[bounds[:-1]], place[bounds[1:]]
            at, done = at + len(part), int(bounds[-1])

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """All ids and the original byte spans of their pieces. A character spelled in bytes ends with its last byte's piece."""
        found = list(self.windows(text))
        return tuple([list(chain.from_iterable(map(list, x))) for x in zip(*found, strict=True)] if found else ([], [], []))

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The library's decoding; `first`: of the start of a text, where the prefix goes."""
        if self.spec.add_dummy_prefix and not self.spec.remove_extra_whitespaces and self.other.isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
            if not first or text.startswith(" "):
                return text[first:]
        # a later window keeps its leading space: a mark in front takes the place of the prefix
        return self.decoder.decode(ids if first else [self.mark, *ids])

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, sha256 of the ids, of the decoded text, and bytes of the original in no piece."""
        n = missed = last = 0
        ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
        for ids, starts, ends in self.windows(text):
            ids_hash.update((("," if n else "") + ",".join(map(self.decimal.__getitem__, ids))).encode())
            text_hash.update(self.decode(ids, first=not n).encode())
            missed += int(np.maximum(starts - np.concatenate([[last], ends[:-1]]), 0).sum())
            n, last = n + len(ids), int(ends[-1]) if len(ends) else last
        return n, ids_hash.hexdigest(), text_hash.hexdigest(), missed + len(text.encode()) - last


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per model and Python worker."""
    return PieceEncoder(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _path(path: str) -> str:
    """The given file, or where this worker has the one of that name."""
    return path if os.path.exists(path) else model_path(os.path.basename(path))


def encode_pieces(docs: DataFrame, path: str, into: str = "pieces") -> DataFrame:
    """`docs` with a column `into`: ids, starts and ends of the pieces, and the decoded text.

    Starts and ends are bytes of the UTF-8 text, end exclusive; white space that
    normalisation drops lies in no piece. Null or empty text: no ids, empty decoded text.
    Texts of any length are segmented in windows of 65,536 characters; a text's own
    arrays must fit a row. Repeated rows each give a row; an empty table gives an empty one.
    Other columns, whatever their names, stay; one named `into` is replaced.
    """

    def one(texts: pd.Series) -> pd.DataFrame:
        tool = encoder(_path(path))
        rows = [tool.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": [r[0] for r in rows], "starts": [r[1] for r in rows], "ends": [r[2] for r in rows], "decoded": [tool.decode(r[0]) for r in rows]})

    kind = "ids array<int>, starts array<long>, ends array<long>, decoded string"
    return docs.withColumn(into, F.pandas_udf(one, kind)("text"))


def encoding_digests(docs: DataFrame, path: str, into: str = "pieces") -> DataFrame:
    """As `encode_pieces`, with digests in place of the arrays: n_tokens, ids_sha256, decoded_sha256, n_missed.

    n_missed: bytes of the text in no piece. Memory is bounded by a text and a
    window's pieces, whatever the number of tokens.
    """

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = encoder(_path(path))
        for texts in batches:
            yield pd.DataFrame([tool.digest(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_missed"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_missed long"
    return docs.withColumn(into, F.pandas_udf(one, kind)("text"))


def op13_piece_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding_digests(docs, model_path()).select("doc_id", "pieces.*")
