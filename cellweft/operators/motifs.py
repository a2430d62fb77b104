"""Sequence under intervals, motif hits, enrichment and conservation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.sequence import revcomp
from cellweft.operators.intervals import interval_score
from cellweft.operators.tables import materialize


def pwm_from_counts(pfm: DataFrame, background: float = 0.25, pseudo: float = 0.5) -> DataFrame:
    """Log-odds weights from base counts (motif, pos, base, n)."""
    total = F.sum(F.col("n") + pseudo).over(Window.partitionBy("motif", "pos"))
    return pfm.select("motif", "pos", "base", F.log2((F.col("n") + pseudo) / total / background).alias("w"))


def interval_sequence(iv: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Bases under each interval (id, chrom, st, en, strand) from chunks (chrom, chunk_start, seq) of `width` bases each.

    An interval is cut along the chunks, and its pieces are joined in order; minus
    strand gives the reverse complement. What no chunk covers is left out.
    """
    need = iv.withColumn("chunk_start", F.explode(F.sequence(F.floor(F.col("st") / width) * width, F.floor((F.col("en") - 1) / width) * width, F.lit(width).cast("long"))))
    j = need.join(chunks, ["chrom", "chunk_start"])
    a = F.greatest(F.col("st") - F.col("chunk_start"), F.lit(0))
    part = F.substring("seq", (a + 1).cast("int"), (F.least(F.col("en") - F.col("chunk_start"), F.lit(width)) - a).cast("int"))
    got = j.withColumn("_p", part).groupBy("id", "strand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_start", "_p"))), lambda s: s["_p"]), "").alias("seq"))
    return got.select("id", F.when(F.col("strand") == "-", revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def motif_scan(seqs: DataFrame, pwm: DataFrame, cut: float) -> DataFrame:
    """Hits id, motif, start (on the plus strand), strand, score of windows that score `cut` or more; windows with other letters than ACGT never do.

    Weights are a small table with a row per motif, position and base. Arrow batches
    of sequences are scored as one array of letters, a shifted addition per position;
    only hits leave the task.
    """
    tables: dict[str, dict[tuple[int, str], float]] = {}
    for m, p, b, w in pwm.select("motif", "pos", "base", "w").collect():  # bounded: motifs by their length by four
        tables.setdefault(m, {})[(p, b)] = float(w)
    kind = dict(seqs.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.full(256, 4, np.int8)
        letters[[ord(c) for c in "ACGT"]] = range(4)
        plus = {m: np.array([[t.get((p, b), np.nan) for b in "ACGT"] + [np.nan] for p in range(max(p for p, _ in t) + 1)]) for m, t in tables.items()}
        for pdf in batches:
            data = [x.encode() if x else b"" for x in pdf["seq"]]
            code = letters[np.frombuffer(b"".join(data), np.uint8)]
            ends = np.cumsum([len(x) for x in data])
            starts = ends - [len(x) for x in data]
            out = []
            for m, w in plus.items():
                n = len(w)
                if len(code) < n:
                    continue
                for strand, own in (("+", w), ("-", w[::-1][:, [3, 2, 1, 0, 4]])):
                    score = own[0][code[: len(code) - n + 1]].copy()
                    for k in range(1, n):
                        score += own[k][code[k : len(code) - n + 1 + k]]
                    hit = np.flatnonzero(score >= cut)
                    doc = np.searchsorted(ends, hit, side="right")
                    inside = hit + n <= ends[doc]
                    hit, doc = hit[inside], doc[inside]
                    out.append(pd.DataFrame({"id": pdf["id"].to_numpy()[doc], "motif": m, "start": (hit - starts[doc]).astype(np.int32), "strand": strand, "score": score[hit]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return seqs.select("id", "seq").mapInPandas(run, f"id {kind}, motif string, start int, strand string, score double")


def gc_content(seqs: DataFrame) -> DataFrame:
    """Length and share of G and C; null for an empty sequence."""
    gc = F.char_length("seq") - F.char_length(F.translate("seq", "GC", ""))
    return seqs.select("id", F.char_length("seq").alias("length"), (gc / F.nullif(F.char_length("seq"), F.lit(0))).alias("gc"))


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """Number of each k-mer over all sequences."""
    starts = F.when(F.char_length("seq") >= k, F.sequence(F.lit(1), F.char_length("seq") - k + 1))
    return seqs.select(F.explode(F.transform(starts, lambda i: F.substring(F.col("seq"), i, F.lit(k)))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def matched_background(fg: DataFrame, pool: DataFrame, n: int, gc_bins: int = 10, width_bins: int = 5) -> DataFrame:
    """For each foreground row n rows of the pool of like GC and width (bins of both), drawn by hash; a bin short of rows gives all it has."""
    key = lambda df: df.withColumns({"_g": F.floor(F.coalesce("gc", F.lit(0.0)) * gc_bins), "_w": F.floor(F.log2(F.col("length") + 1) * width_bins / 8)})
    want = key(fg).groupBy("_g", "_w").agg((F.count("*") * n).alias("_n"))
    rest = key(pool.join(fg.select("id"), "id", "left_anti"))
    place = F.row_number().over(Window.partitionBy("_g", "_w").orderBy(F.xxhash64("id"), "id"))
    return rest.withColumn("_k", place).join(want, ["_g", "_w"]).where("_k <= _n").select(*pool.columns)


def log_choose(n: Column, k: Column) -> Column:
    """Natural log of a binomial coefficient by Stirling's series, exact to about 1e-10."""

    def lf(x: Column) -> Column:
        y = x.cast("double") + 1.0
        big = y + 7.0
        shift = F.log(y * (y + 1) * (y + 2) * (y + 3) * (y + 4) * (y + 5) * (y + 6))
        series = (big - 0.5) * F.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big * big * big) + 1 / (1260 * F.pow(big, F.lit(5.0)))
        return series - shift

    return lf(n) - lf(k) - lf(n - k)


def hypergeometric_tail(population: Column, hits: Column, draws: Column, overlap: Column) -> Column:
    """Chance of at least `overlap` hits among the draws."""
    terms = F.transform(F.sequence(F.greatest(overlap, draws + hits - population, F.lit(0)), F.least(hits, draws)), lambda i: F.exp(log_choose(hits, i) + log_choose(population - hits, draws - i) - log_choose(population, draws)))
    return F.when(overlap > F.least(hits, draws), F.lit(0.0)).otherwise(F.least(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)))


def motif_enrichment(hits: DataFrame, fg: DataFrame, bg: DataFrame) -> DataFrame:
    """Per motif: foreground and background sequences with a hit, odds ratio (with half counts added) and the hypergeometric tail."""
    side = fg.select("id").withColumn("_f", F.lit(1)).unionByName(bg.select("id").withColumn("_f", F.lit(0)))
    total = side.agg(F.sum("_f").alias("n_fg"), F.sum(1 - F.col("_f")).alias("n_bg"))
    k = hits.select("id", "motif").distinct().join(side, "id").groupBy("motif").agg(F.sum("_f").alias("k_fg"), F.sum(1 - F.col("_f")).alias("k_bg"))
    j = k.join(F.broadcast(total))  # total is one row
    a, b, c, d = F.col("k_fg") + 0.5, F.col("n_fg") - F.col("k_fg") + 0.5, F.col("k_bg") + 0.5, F.col("n_bg") - F.col("k_bg") + 0.5
    tail = hypergeometric_tail(F.col("n_fg") + F.col("n_bg"), F.col("k_fg") + F.col("k_bg"), F.col("n_fg"), F.col("k_fg"))
    return j.select("motif", "k_fg", "n_fg", "k_bg", "n_bg", (a * d / (b * c)).alias("odds"), tail.alias("p"))


def motif_deviation(atac: DataFrame, hits: DataFrame, bg: DataFrame) -> DataFrame:
    """Per cell and motif: observed over expected accessibility, and its z-score against background element sets.

    `hits` has motif, feature; `bg` motif, draw, feature. Expected: the cell's total
    times the set's share of all counts. A cell without counts in a set deviates by -1, so
    means and spreads over a motif's draws follow from sums over the sets in which a cell
    has counts; cells times draws are never made. The shares of the motifs' own sets, a row per
    motif, go to all tasks, as the result has a row per cell and motif.
    """
    cell = atac.groupBy("cell").agg(F.sum("x").alias("_ct"))
    feat = materialize(atac.groupBy("feature").agg(F.sum("x").alias("_ft")), "totals")
    total = feat.agg(F.sum("_ft").alias("_all"))

    def shares(sets: DataFrame, keys: list[str]) -> DataFrame:
        return sets.join(feat, "feature").groupBy(*keys).agg(F.sum("_ft").alias("_st"))

    def ratios(sets: DataFrame, share: DataFrame, keys: list[str]) -> DataFrame:
        """Observed over expected where a cell has counts in a set."""
        got = atac.join(sets, "feature").groupBy("cell", *keys).agg(F.sum("x").alias("_o"))
        got = got.join(share, keys).join(cell, "cell").join(F.broadcast(total))  # one row
        return got.select("cell", *keys, (F.col("_o") * F.col("_all") / (F.col("_ct") * F.col("_st"))).alias("_r"))

    sets, null = hits.select("motif", "feature").distinct(), bg.select("motif", "draw", "feature").distinct()
    share, null_share = materialize(shares(sets, ["motif"]), "shares"), materialize(shares(null, ["motif", "draw"]), "shares")
    draws = null_share.groupBy("motif").agg(F.count("*").cast("double").alias("_d"))
    own = ratios(sets, share, ["motif"])
    spread = ratios(null, null_share, ["motif", "draw"]).groupBy("cell", "motif").agg(F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_ss"))
    every = cell.select("cell").join(F.broadcast(share.join(draws, "motif").select("motif", "_d")))  # a row per motif
    j = every.join(own, ["cell", "motif"], "left").join(spread, ["cell", "motif"], "left").fillna(0.0, ["_r", "_s", "_ss"])
    mean = F.col("_s") / F.col("_d")
    var = (F.col("_ss") - F.col("_d") * mean * mean) / F.nullif(F.col("_d") - 1, F.lit(0.0))
    var = F.when(var > 1e-12 * (F.col("_ss") + 1), var)
    return j.select("cell", "motif", (F.col("_r") - 1).alias("dev"), ((F.col("_r") - mean) / F.sqrt(var)).alias("z"))


def conserved_enrichment(fg: DataFrame, bg: DataFrame, track: DataFrame, cut: float) -> DataFrame:
    """Are intervals of the foreground more often conserved (mean score of `cut` or more) than the background's? One row of counts, odds and tail."""
    good = lambda iv: interval_score(iv, track).agg(F.count(F.when(F.col("mean") >= cut, 1)).alias("k"), F.count("*").alias("n"))
    a, b = good(fg).withColumnsRenamed({"k": "k_fg", "n": "n_fg"}), good(bg).withColumnsRenamed({"k": "k_bg", "n": "n_bg"})
    j = a.join(F.broadcast(b))  # one row each
    odds = (F.col("k_fg") + 0.5) * (F.col("n_bg") - F.col("k_bg") + 0.5) / ((F.col("n_fg") - F.col("k_fg") + 0.5) * (F.col("k_bg") + 0.5))
    tail = hypergeometric_tail(F.col("n_fg") + F.col("n_bg"), F.col("k_fg") + F.col("k_bg"), F.col("n_fg"), F.col("k_fg"))
    return j.select("k_fg", "n_fg", "k_bg", "n_bg", odds.alias("odds"), tail.alias("p"))
