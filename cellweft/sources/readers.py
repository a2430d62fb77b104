"""Readers of the plain-text formats of the field, and a partitioned sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.sources.lines import placed_lines, under_headers


def read_counts(spark: SparkSession, matrix: str, barcodes: str, features: str, sample: str) -> DataFrame:
    """Sparse triplets (row, column, value, 1-based, '%' comments and a size line) with their names: sample, cell, feature, x.

    Files, or folders whose files go by their paths. Lines are read in any splits; names
    get their number from their place, counted within a split and over the splits before it.
    """
    lines = placed_lines(spark, matrix).where("not startswith(value, '%') and trim(value) <> ''").withColumn("_m", F.struct("file", "split", "n"))
    # the first line that is no comment holds the sizes; it is known by its place, as an entry may equal it
    first = lines.agg(F.min("_m").alias("_first"))
    part = F.split(F.trim("value"), r"\s+")
    body = lines.join(F.broadcast(first)).where("_m > _first").select(part[0].cast("long").alias("i"), part[1].cast("long").alias("j"), part[2].cast("double").alias("x"))  # one row
    name = lambda path, col: under_headers(placed_lines(spark, path), F.lit(True), F.col("value"), F.lit(0)).select(F.col("number").alias("n"), F.split("value", "\t")[0].alias(col))
    out = body.join(name(features, "feature"), F.col("i") == F.col("n")).drop("n").join(name(barcodes, "cell"), F.col("j") == F.col("n"))
    return out.select(F.lit(sample).alias("sample"), "cell", "feature", "x")


def read_fragments(spark: SparkSession, path: str, sample: str, partitions: int | None = None) -> DataFrame:
    """Five tab-separated columns: chrom, st, en, cell, n. A gzip file is one split, so rows are dealt out again on request."""
    out = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, st long, en long, cell string, n int")
    out = out.withColumn("sample", F.lit(sample))
    return out.repartition(partitions, "chrom", F.floor(F.col("st") / 1_000_000)) if partitions else out


def read_intervals(spark: SparkSession, path: str, fmt: str = "bed") -> DataFrame:
    """BED (0-based) or GTF (1-based, attributes to a map) rows: id, chrom, st, en, strand, attrs."""
    if fmt == "bed":
        raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, st long, en long, id string, score string, strand string")
        return raw.select("id", "chrom", "st", "en", "strand", F.create_map().cast("map<string,string>").alias("attrs"))
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, kind string, st long, en long, score string, strand string, frame string, attr string")
    pairs = F.regexp_replace(F.regexp_replace("attr", r';\s*$', ""), r'\s*([^\s;]+)\s+"([^"]*)"', "$1=$2")
    attrs = F.str_to_map(pairs, F.lit(";"), F.lit("="))
    return raw.withColumn("attrs", attrs).select(F.coalesce(F.try_element_at("attrs", F.lit("gene_id")), F.concat_ws(":", "chrom", "st")).alias("id"), "chrom", (F.col("st") - 1).alias("st"), "en", "strand", "attrs")


def read_sequence(spark: SparkSession, path: str, width: int, overlap: int = 0) -> DataFrame:
    """FASTA records as chunks: chrom, chunk_start, seq of `width` bases plus `overlap` of the next.

    Lines are read in as many splits as Spark likes; each knows its record and its place in it
    from running sums, and gives its bases to the chunks it reaches, so a chromosome
    is many tasks and no row is longer than a line or a chunk. Records of one name in
    several places stay apart.
    """
    bases = F.regexp_replace("value", r"\s", "")
    lines = placed_lines(spark, path).where("value <> ''")
    own = under_headers(lines, F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S*)", 1), F.char_length(bases))
    rows = own.where("not is_header and title is not null").select("number", F.col("title").alias("chrom"), "before", bases.alias("bases")).where("bases <> ''")
    first = F.greatest(F.floor((F.col("before") - overlap) / width), F.lit(0))
    last = F.floor((F.col("before") + F.char_length("bases") - 1) / width)
    rows = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * width - F.col("before"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * width + overlap - F.col("before"), F.char_length("bases"))
    parts = rows.where(begin < end).select("number", "chrom", "chunk", F.struct((F.col("before") + begin).alias("at"), F.col("bases").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("bases")).alias("part"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["bases"]), "")  # width + overlap bases
    return parts.groupBy("number", "chrom", "chunk").agg(seq.alias("seq")).select("chrom", (F.col("chunk") * width).alias("chunk_start"), "seq")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-alignment blocks ('a' lines, each with 's' rows): block, species, chrom, st, en, strand, src_size, text.

    Blocks are numbered in the order of the files' paths and lines, whichever splits they
    are read in. A source 'species.chrom' is parted at its first dot; without one it is both. Places are turned to
    the plus strand, half-open: a row on the minus strand covers src_size - start - size on.
    Other lines (comments, 'i', 'e', 'q') are passed over.
    """
    lines = placed_lines(spark, path).where("value rlike '^[as]([ \\\\t]|$)'")
    own = under_headers(lines, F.col("value").startswith("a"), F.lit("a"), F.lit(0)).where("not is_header and title is not null")
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = own.where(F.size(f) >= 7).select((F.col("number") - 1).alias("block"), f[1].alias("src"), f[2].cast("long").alias("_st"), f[3].cast("long").alias("_n"), f[4].alias("strand"), f[5].cast("long").alias("src_size"), f[6].alias("text"))
    st = F.when(F.col("strand") == "-", F.col("src_size") - F.col("_st") - F.col("_n")).otherwise(F.col("_st"))
    chrom = F.when(F.col("src").contains("."), F.regexp_extract("src", r"^[^.]*\.(.*)$", 1)).otherwise(F.col("src"))
    return rows.select("block", F.substring_index("src", ".", 1).alias("species"), chrom.alias("chrom"), st.alias("st"), (st + F.col("_n")).alias("en"), "strand", "src_size", "text")


def read_align_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Chain files (header line, then size, gap here, gap there) as blocks in both species.

    Records are parted by an empty line. A block's place is the running sum of the
    sizes and gaps before it; on the minus strand it is turned to the plus strand.
    """
    rec = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) like 'chain%'").select(F.split(F.trim("value"), "\n").alias("l"))
    h = F.split(F.col("l")[0], r"\s+")
    rows = rec.select(*[h[i].alias(n) for i, n in ((2, "src_chrom"), (5, "t0"), (7, "dst_chrom"), (8, "q_size"), (9, "dst_strand"), (10, "q0"), (12, "chain"))], F.posexplode(F.slice(F.col("l"), F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("k", "line"))
    f = F.split(F.trim("line"), r"\s+")
    g = lambda i: F.coalesce(F.get(f, F.lit(i)).cast("long"), F.lit(0))
    rows = rows.select("src_chrom", "dst_chrom", "dst_strand", F.col("chain").cast("long"), F.col("t0").cast("long"), F.col("q0").cast("long"), F.col("q_size").cast("long"), "k", g(0).alias("n"), g(1).alias("dt"), g(2).alias("dq"))
    before = Window.partitionBy("chain").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    s = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumns({"src_start": F.col("t0") + s(F.col("n") + F.col("dt")), "_q": F.col("q0") + s(F.col("n") + F.col("dq"))})
    dst = F.when(F.col("dst_strand") == "+", F.col("_q")).otherwise(F.col("q_size") - F.col("_q") - F.col("n"))
    return rows.select("src_chrom", "src_start", (F.col("src_start") + F.col("n")).alias("src_end"), "dst_chrom", dst.alias("dst_start"), (dst + F.col("n")).alias("dst_end"), "dst_strand", "chain")


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """Score windows: chrom, st, en, score; header lines are passed over."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, st long, en long, score double")
    return raw.where("st is not null and en is not null")


def read_pwm(spark: SparkSession, path: str) -> DataFrame:
    """Motif tables ('>name' and a line of four numbers per position): motif, pos, base, w."""
    rec = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''").select(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = rec.select(F.split(F.col("l")[0], r"\s")[0].alias("motif"), F.posexplode(F.slice(F.col("l"), F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("pos", "line"))
    return rows.select("motif", "pos", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("_b", "w")).select("motif", "pos", F.element_at(F.array(*map(F.lit, "ACGT")), F.col("_b") + 1).alias("base"), F.col("w").cast("double"))


def write_table(df: DataFrame, path: str, by: list[str], files: int | None = None) -> None:
    """Parquet partitioned by columns; rows of a partition are gathered first, `files` ways at most, so that files stay few."""
    salt = [] if files is None else [F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith("map")]), F.lit(files))]
    df.repartition(*by, *salt).write.mode("overwrite").partitionBy(*by).parquet(path)
