"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best fit: pieces arrive in blocks, and only a fixed number of
sequences is open at a time, whatever the number of pieces. So a task needs memory
for one block and the open sequences, and no count of the pieces is needed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cellweft.llm.common import materialize, table

#: Fixed value: the pattern by which byte-level vocabularies cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts by a `tokenizers` file, as little-endian 32-bit numbers.

    For a plain byte-level BPE file whose ids follow the order of its merges, the same
    ids come some six times faster from tiktoken, fed with the file's vocabulary as ranks
    (tests compare both). Any other file is left to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = _ranked(json.load(f))

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict):
    """A tiktoken encoding with the same ids, or None where the file is of another kind."""
    import tiktoken

    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    options = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or not x["special"] for x in spec.get("added_tokens") or [])
    if model["type"] != "BPE" or any(options) or spec.get("normalizer") or not plain:
        return None
    if cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise_pieces(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 0, keep_ids: bool = True, batch: int = 256) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and `end_id`. One of more than `most` ids is cut so that
    all pieces but the first have `most` ids. Null text: empty, so one id. Null
    doc_id: kept as null. Repeated rows: each is a document. Empty table: no rows.
    A text is encoded whole, in one task: that takes some 20 times its length in
    memory. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4")
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([enc.ids(text or ""), end])
                    n = len(ids)
                    cuts = [0, *range(n % most or most, n + 1, most)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e]))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[5]).view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [("doc_id", LongType()), ("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType())]
    schema = StructType([StructField(n, t) for n, t in fields] + ([StructField("ids", ArrayType(IntegerType()))] if keep_ids else []))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class OpenBins:
    """At most `open_bins` open bins of `most` places each.

    They hang on lists by free space, and bit f of an integer is set while some open
    bin has f free: the lowest set bit at or above an item's length is the tightest
    bin. With no such bin a new one opens, and if too many are open the fullest
    closes. A bin without free space closes at once.
    """

    def __init__(self, most: int, open_bins: int):
        self.most, self.open_bins = most, open_bins
        self.free: list[list[int]] = [[] for _ in range(most + 1)]
        self.bits = self.n_open = self.n_bins = self.n_closed_early = 0

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each item, in the order given; what is open stays open for the next call."""
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i, x in enumerate(lengths.tolist()):
            fits = self.bits >> x
            if fits:
                room = x + (fits & -fits).bit_length() - 1
                b = self._take(room)
            else:
                b, room = self.n_bins, self.most
                self.n_bins += 1
            bins[i], offsets[i] = b, self.most - room
            room -= x
            if room:
                self.free[room].append(b)
                self.bits |= 1 << room
                self.n_open += 1
                if self.n_open > self.open_bins:
                    self._take((self.bits & -self.bits).bit_length() - 1)
                    self.n_closed_early += 1
        return bins, offsets

    def _take(self, room: int) -> int:
        b = self.free[room].pop()
        if not self.free[room]:
            self.bits &= ~(1 << room)
        self.n_open -= 1
        return b


def pack(pieces: DataFrame, most: int = 2048, open_bins: int = 4096, block: int = 4096, deal: bool = True) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and any others; columns of these two names are replaced).

    Pieces of `most` tokens are sequences by themselves and are not shuffled. The rest
    is dealt evenly to tasks, row by row and not by any key, so that equal rows do not meet
    in one. A task takes its rows in an order by hash, in blocks of `block` pieces, the
    long ones of a block first, and packs them with `open_bins` open sequences, which
    stay open from block to block. Empty table: empty.

    `deal=False` packs each partition as it stands, full pieces among the others, in one
    pass and without a shuffle: for wide pieces (ids) whose partitions are in no order of
    length. What is open at the end of a partition, `open_bins` at most, stays unfilled.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = pieces.select(*names)
    schema = StructType([*own.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bins = TaskContext.get().partitionId() << 40, OpenBins(most, open_bins)

        def placed(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for start in range(0, sum(r.num_rows for r in rows), block):
                t = pa.Table.from_batches(rows).slice(start, block)
                lengths = t.column(at).to_numpy()
                order = np.argsort(-lengths, kind="stable")
                b, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                b[order], offset[order] = bins.place(lengths[order])
                t = t.append_column("sequence_id", pa.array((first + b) * 2 + 1)).append_column("offset", pa.array(offset))
                yield from t.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(r.num_rows for r in held) >= block:
                yield from placed(held)
                held = []
        yield from placed(held)

    if not deal:
        return own.mapInArrow(run, schema)
    order = F.xxhash64(*[c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in names])
    rest = own.where(F.col("length") < most).hint("rebalance").withColumn("_cw_order", order).sortWithinPartitions("_cw_order", "length").select(*names)
    full = own.where(F.col("length") >= most).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.mapInArrow(run, schema).unionByName(full)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pack(spark, sf_dir):
    pieces = tokenise_pieces(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)
    return pack(materialize(pieces, "pieces"))
