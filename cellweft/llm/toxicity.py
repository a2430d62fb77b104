"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Bounded sample: the model is fitted on at most `max_rows` labelled rows (those with
the smallest hash of doc_id, whatever their label, so that the classes keep their
shares), and training time does not grow; scoring covers every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cellweft.llm import textvec as tv
from cellweft.llm.common import hash32, table

BITS = 20
#: Bytes of words: ASCII letters and digits, and every byte of a longer character.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and skip pairs (one word left out), and the index of their text."""
    buf, offsets = tv.joined(texts)
    h, doc = tv.words(_LOWER[buf], offsets, _INSIDE[buf])
    kinds = [(h, doc)]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            kinds.append((tv.mix64(h[:-gap] * np.uint64(salt) + h[gap:])[same], doc[:-gap][same]))
    mask = np.uint64((1 << BITS) - 1)
    return np.concatenate([(k & mask) for k, _ in kinds]).astype(np.int64), np.concatenate([d for _, d in kinds])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = tv.text_column(batch, "text"), []
        for a, b in tv.groups(texts):
            f, d = features(texts[a:b])
            key = np.unique(d << BITS | f)
            cut = np.searchsorted(key >> BITS, np.arange(b - a + 1))
            f = (key & ((1 << BITS) - 1)).astype(np.int32)
            rows += [f[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["place", "features", "toxic"])


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.2, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0, epochs: int = 5) -> np.ndarray:
    """Weights by FTRL-proximal; the last one is the bias (not under l1). Features are binary."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        w[-1] = -zi[-1] / ((beta + np.sqrt(n[bias])) / alpha)
        return w

    for _ in range(epochs):
        for f, y in zip(rows, labels, strict=True):
            i = np.append(f, bias)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def calibrated(rows: list[np.ndarray], labels: np.ndarray, hold: int = 5) -> np.ndarray:
    """FTRL weights from all but each `hold`-th row, the bias shifted so that a score of 0.5 makes fewest errors on the rest."""
    kept = [i for i in range(len(rows)) if i % hold == 0]
    fit = [i for i in range(len(rows)) if i % hold != 0] or kept
    w = ftrl([rows[i] for i in fit], labels[fit])
    margin = np.array([w[rows[i]].sum() + w[-1] for i in kept])
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], labels[kept][order]
    if 0 < y.sum() < len(y):
        missed = np.concatenate([[0], np.cumsum(y)])
        errors = missed + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
        best = np.flatnonzero(errors == errors.min())
        j = int(best[len(best) // 2])
        low, high = (m[j - 1] if j else m[0] - 1), (m[j] if j < len(m) else m[-1] + 1)
        w[-1] -= (low + high) / 2
    return w


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights that are not zero, from all rows of one (bounded) partition."""
    rows, place, label = [], [], []
    for batch in batches:
        for b in _feature_rows([batch]):
            rows += [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
            place += b.column(0).to_pylist()
            label += b.column(2).to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (place[i], label[i], len(rows[i])))
    w = calibrated([rows[i] for i in order], np.array(label, np.float64)[order])
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 18000) -> np.ndarray:
    """Weights learned from the texts of `docs` and labels (doc_id, toxic); no labelled row: all zero.

    The sample is chosen among the labels alone; only its texts are read further,
    and one task fits the model to them.
    """
    place = hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(own.withColumn("place", place).orderBy("place", "doc_id").limit(max_rows))  # at most max_rows rows of three numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("place", "text", "toxic")
    got = rows.repartition(1).mapInArrow(_train_rows, "feature int, weight float").toPandas()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[got.feature.to_numpy()] = got.weight.to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, into: str = "score") -> DataFrame:
    """Adds a score (0 to 1, column `into`) to the rows of `docs`; only its text is read.

    A text's evidence is the sum of the weights of its distinct features. Null
    and empty texts get the bias alone. Equal texts get equal scores. Empty table:
    empty. Texts are read whole; memory is some 60 times the longest text. Other columns
    are passed on; one named as `into` is replaced.
    """
    spark = docs.sparkSession
    at = np.flatnonzero(weights[:-1])
    sent = spark.sparkContext.broadcast((at.astype(np.int32), weights[at], float(weights[-1])))  # at most 2**20 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, val, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[idx] = val
        for batch in batches:
            texts, out = tv.text_column(batch, "text"), []
            for a, b in tv.groups(texts):
                f, d = features(texts[a:b])
                used = w[f] != 0
                key = np.unique(d[used] << BITS | f[used])
                total = np.bincount(key >> BITS, weights=w[key & ((1 << BITS) - 1)].astype(np.float64), minlength=b - a)
                out.append(1.0 / (1.0 + np.exp(-np.clip(total + bias, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], schema=pa.schema([*batch.schema, pa.field(into, pa.float64())]))

    docs = docs.drop(into)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fifth (crc32 of doc_id as text, modulo 5, is 0)."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "toxic")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
