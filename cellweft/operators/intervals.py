"""Genomic intervals, 0-based and half-open: overlap join and what builds on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.tables import materialize, parts


def _level(width: int, spans: int = 1) -> Column:
    """The lowest level (bins of width * 4**level) at which an interval is `spans` bins wide at most, so lies in one more at most."""
    return F.greatest(F.ceil(F.log2((F.col("en") - F.col("st")) / (width * spans)) / 2), F.lit(0)).cast("int")


def _size(width: int) -> Column:
    """Width of a row's bin at its _level."""
    return F.expr(f"shiftleft({width}L, 2 * _level)")


def _cut(df: DataFrame, own: list[int], other: list[int], width: int, spans: int) -> DataFrame:
    """A row for each of an interval's bins (_level, _bin), at its own level and at those higher levels where the other side has intervals."""
    at = F.array(F.lit(0))
    for lv in own if max(own + other, default=0) else []:
        at = F.when(_level(width, spans) == lv, F.array(*[F.lit(x) for x in sorted({lv, *[x for x in other if x > lv]})])).otherwise(at)
    df = df.withColumn("_level", F.explode(at))  # never a literal, by which Spark would not keep rows dealt
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("st") / _size(width)), F.floor((F.col("en") - 1) / _size(width)))))


#: Pairs that meet in a task of the overlap join.
MEET = 50_000_000
_KEYS = ["_bin", "chrom", "_level"]  # bins first: they tell most rows apart, so sorts seldom look further


def binned(a: DataFrame, b: DataFrame, width: int, most: int = 20_000, spans: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns _level, _bin, _s and _t: rows that may overlap share all four in exactly one place or, over a bin's edge, two (`spans` + 1 at most).

    A bin with over `most` rows of a side (or a ten-thousandth of all, so that such bins are few) is
    hot: its rows are dealt to parts of that size by hash and repeated for each part of the
    other side, so that a task gets `most` rows of each. Where many rows meet, both sides are dealt so that
    some MEET pairs do so in a task: their bytes say nothing of the work, as pairs grow with the square of a bin's rows.
    """
    a, b = a.where("en > st and chrom is not null"), b.where("en > st and chrom is not null")
    seen = a.select(F.lit(0).alias("side"), _level(width, spans).alias("level")).unionByName(b.select(F.lit(1).alias("side"), _level(width, spans).alias("level"))).groupBy("side", "level").count().collect()  # a row per level
    levels = [sorted(r["level"] for r in seen if r["side"] == side) for side in (0, 1)]
    total = [sum(r["count"] for r in seen if r["side"] == side) for side in (0, 1)]
    left, right = _cut(a, *levels, width, spans), _cut(b, *reversed(levels), width, spans)
    limit = max(most, sum(total) // 10_000)
    if max(total) <= limit:
        return left.withColumns({"_s": F.lit(0), "_t": F.lit(0)}), right.withColumns({"_s": F.lit(0), "_t": F.lit(0)})
    rows = lambda df, n: df.groupBy(*_KEYS).agg(F.count("*").alias(n))
    cells = materialize(rows(left, "_ns").join(rows(right, "_nt"), _KEYS), "bins")
    n_pairs, n_rows = cells.agg(F.sum(F.col("_ns").cast("double") * F.col("_nt")), F.sum(F.col("_ns") + F.col("_nt"))).first()
    hot = cells.select(*_KEYS, *[F.ceil(F.col(n) / limit).cast("int").alias(n) for n in ("_ns", "_nt")]).where("_ns > 1 or _nt > 1")
    hot = F.broadcast(hot)  # some 10,000 bins per level at most
    some = F.array(F.lit(0))
    salt = lambda df, n: F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]), F.col(n)).cast("int"), F.lit(0))
    every = lambda n: F.explode(F.coalesce(F.sequence(F.lit(0), F.col(n) - 1), some))
    x, y = [df.join(hot, _KEYS, "left").select(*df.columns, "_ns", "_nt") for df in (left, right)]
    x = x.withColumn("_s", salt(left, "_ns")).withColumn("_t", every("_nt")).drop("_ns", "_nt")
    y = y.withColumn("_t", salt(right, "_nt")).withColumn("_s", every("_ns")).drop("_ns", "_nt")
    n = max(parts(a, int(n_pairs or 0), MEET) or 0, parts(a, n_rows or 0) or 0)
    return (x.repartition(n, *_KEYS, "_s", "_t"), y.repartition(n, *_KEYS, "_s", "_t")) if n else (x, y)


def interval_join(a: DataFrame, b: DataFrame, width: int = 2000, most: int = 20_000, spans: int = 1) -> DataFrame:
    """Pairs of overlapping intervals of the same chrom.

    Both sides have chrom, st, en; the columns of `b` get the prefix b_. Bins come in levels, each
    four times as wide as the one below, and an interval has two bins at most at its own level; it
    is also put in the bins above it, at levels where the other side has intervals. So a
    pair meets at the level of the longer one, an interval of any length costs a bounded
    number of rows, and a pair is kept in the bin where the later one starts, once,
    without a distinct. Hot bins are split (`most`: rows of a side). Empty intervals (en <= st) overlap nothing.

    `spans`: an interval may be so many bins wide at its own level. More of them are more rows that are shuffled, but
    fewer pairs that meet and do not overlap, which where intervals lie dense are most of the work.
    """
    left, right = binned(a, b, width, most, spans)
    # what a pair asks of a row alone is found once a row: 1, this is its own level; 2, it starts in this bin
    flags = F.when(F.col("_level") == _level(width, spans), 1).otherwise(0) + F.when(F.col("_bin") == F.floor(F.col("st") / _size(width)), 2).otherwise(0)
    left, right = left.withColumn("_flags", flags), right.withColumn("_flags", flags)
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    here = (F.col("_bin") == F.col("b__bin")) & (F.col("chrom") == F.col("b_chrom")) & (F.col("_level") == F.col("b__level")) & (F.col("_s") == F.col("b__s")) & (F.col("_t") == F.col("b__t"))
    overlap = (F.col("st") < F.col("b_en")) & (F.col("b_st") < F.col("en"))
    once = F.col("_flags").bitwiseOR(F.col("b__flags")) == 3  # the longer one's level, and the bin where the later one starts
    hidden = ("_bin", "_level", "_flags", "_s", "_t")
    return left.join(right, here & overlap & once).drop(*hidden, *[f"b_{c}" for c in hidden], "b_chrom")


def overlap_length() -> Column:
    return F.least("en", "b_en") - F.greatest("st", "b_st")


def merge_intervals(iv: DataFrame, gap: int = 0, stretch: int = 100_000) -> DataFrame:
    """Union of intervals per chrom; those at most `gap` apart become one. n: how many went in.

    Windows run over stretches of `stretch` bases (of the start), so a chromosome is many
    tasks. What a stretch must know of those before it is one value each: the furthest end,
    and how many unions begin there; windows over these pass a row per stretch.
    """
    keyed = iv.withColumn("_part", F.floor(F.col("st") / stretch))
    earlier = Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = keyed.groupBy("chrom", "_part").agg(F.max("en").alias("_far")).withColumn("_far", F.max("_far").over(earlier))
    order = Window.partitionBy("chrom", "_part").orderBy("st", "en")
    before = F.greatest(F.max("en").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_far")
    parts = keyed.join(reach, ["chrom", "_part"]).withColumn("_new", F.when(F.col("st") <= before + gap, 0).otherwise(1))
    parts = parts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a union that goes on over stretches has the number that it began with
    some = parts.groupBy("chrom", "_part", "_island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("n"))
    begun = parts.groupBy("chrom", "_part").agg(F.sum("_new").alias("_begun")).withColumn("_begun", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)))
    some = some.join(begun, ["chrom", "_part"]).withColumn("_island", F.col("_island") + F.col("_begun"))
    return some.groupBy("chrom", "_island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.sum("n").alias("n")).drop("_island")


def frac_in_peaks(frag: DataFrame, peaks: DataFrame, width: int = 2000) -> DataFrame:
    """Share of each cell's fragments that touch any peak; peaks are merged first, so a fragment joins few."""
    hit = interval_join(frag, merge_intervals(peaks), width).select("fid").distinct().withColumn("hit", F.lit(1))
    return frag.join(hit, "fid", "left").groupBy("cell").agg(F.count("*").alias("n"), F.count("hit").alias("n_in"), (F.count("hit") / F.count("*")).alias("frac"))


def tss_enrichment(frag: DataFrame, tss: DataFrame, win: int = 2000, centre: int = 200, width: int = 2000) -> DataFrame:
    """Per cell: fragment mid-points within `centre` of a gene start over those in the outer flanks, per base.

    Without flank counts the ratio is null.
    """
    around = tss.select("gene", "chrom", (F.col("tss") - win).alias("st"), (F.col("tss") + win + 1).alias("en"), "tss")
    mid = frag.select("fid", "cell", "chrom", F.floor((F.col("st") + F.col("en")) / 2).alias("st")).withColumn("en", F.col("st") + 1)
    at = F.abs(F.col("st") - F.col("b_tss"))
    flank = win - centre
    out = interval_join(mid, around, width).groupBy("cell").agg(F.sum(F.when(at <= centre, 1).otherwise(0)).alias("centre"), F.sum(F.when(at > flank, 1).otherwise(0)).alias("flank"))
    return out.withColumn("ratio", F.when(F.col("flank") > 0, (F.col("centre") / (2 * centre + 1)) / (F.col("flank") / (2 * centre))))


def dedup_fragments(frag: DataFrame) -> DataFrame:
    """Equal fragments of a cell as one row with their count."""
    return frag.groupBy("cell", "chrom", "st", "en").agg(F.count("*").alias("n"))


def frag_length_hist(frag: DataFrame, edges: list[int]) -> DataFrame:
    """Fragments per cell and length class: class i holds edges[i-1] <= length < edges[i]."""
    length = F.col("en") - F.col("st")
    cls = F.lit(0)
    for e in edges:
        cls = cls + F.when(length >= e, 1).otherwise(0)
    return frag.groupBy("cell", cls.alias("cls")).agg(F.count("*").alias("n"))


def frag_length_ratio(frag: DataFrame, cut: int) -> DataFrame:
    """Per cell: fragments shorter than `cut`, the others, and their ratio (null without longer ones)."""
    short = F.col("en") - F.col("st") < cut
    n = frag.groupBy("cell").agg(F.count(F.when(short, 1)).alias("n_short"), F.count(F.when(~short, 1)).alias("n_long"))
    return n.withColumn("ratio", F.col("n_short") / F.nullif("n_long", F.lit(0)))


def tile_counts(frag: DataFrame, size: int) -> DataFrame:
    """Fragments per cell and tile of their start."""
    return frag.groupBy("cell", "chrom", (F.floor(F.col("st") / size) * size).alias("tile")).agg(F.count("*").alias("x"))


def interval_score(iv: DataFrame, track: DataFrame, width: int = 2000) -> DataFrame:
    """Length-weighted mean score under each interval and the share of it that is covered; without cover mean null, share 0.

    The track's windows must not overlap each other.
    """
    ov = overlap_length()
    got = interval_join(iv, track, width).groupBy("pid").agg((F.sum(F.col("b_score") * ov) / F.sum(ov)).alias("mean"), F.sum(ov).alias("covered"))
    out = iv.join(got, "pid", "left")
    return out.select("pid", "mean", (F.coalesce("covered", F.lit(0)) / (F.col("en") - F.col("st"))).alias("share"))


def score_profile(iv: DataFrame, track: DataFrame, n: int, width: int = 2000) -> DataFrame:
    """Mean score by relative position: track windows' mid-points in n equal parts of the intervals."""
    mid = track.select("chrom", F.floor((F.col("st") + F.col("en")) / 2).alias("st"), "score").withColumn("en", F.col("st") + 1)
    part = F.floor((F.col("b_st") - F.col("st")) * n / (F.col("en") - F.col("st"))).cast("int")
    return interval_join(iv, mid, width).groupBy(part.alias("part")).agg(F.avg("b_score").alias("mean"), F.count("*").alias("n"))


def peak_gene_pairs(peaks: DataFrame, tss: DataFrame, reach: int, spans: int = 4) -> DataFrame:
    """Peaks whose middle lies within `reach` of a gene start, with the distance signed by the gene's strand.

    A gene's surroundings are `spans` bins wide, so it meets some 1 / `spans` more peaks than there are pairs.
    """
    around = tss.select("gene", "chrom", (F.col("tss") - reach).alias("st"), (F.col("tss") + reach + 1).alias("en"), "tss", "strand")
    mid = peaks.select("pid", "chrom", F.floor((F.col("st") + F.col("en")) / 2).alias("st")).withColumn("en", F.col("st") + 1)
    d = F.col("st") - F.col("b_tss")
    return interval_join(mid, around, -(-(2 * reach + 1) // spans), spans=spans).select("pid", F.col("b_gene").alias("gene"), F.when(F.col("b_strand") == "+", d).otherwise(-d).alias("distance"))
