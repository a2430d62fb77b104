"""Queries of the text readers: views of the given tables, written as the format's text and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators.running import running_totals
from cellweft.operators.tables import materialize, shared_dir
from cellweft.plans.views import duck, r, view
from cellweft.sources import readers

Q, SQL = {}, {}


def _add(name: str, sql: str):
    def keep(fn):
        Q[name], SQL[name] = fn, sql
        return fn

    return keep


def _text(df: DataFrame, what: str) -> str:
    """Folder with the rows as tab-separated text."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.csv(path, sep="\t")
    return path


@_add("s2_read_fragments", duck("select chrom, st, en, cell::varchar cell, 1 n, 's' sample from m_frag", "m_frag"))
def s2(spark, d):
    rows = view(spark, d, "m_frag").select("chrom", "st", "en", "cell", F.lit(1).alias("n"))
    return readers.read_fragments(spark, _text(rows, "fragments"), "s", 8)


@_add("s3_read_intervals", duck("select pid::varchar id, chrom, st, en, case when pid % 2 = 0 then '+' else '-' end strand from m_peaks", "m_peaks"))
def s3(spark, d):
    rows = view(spark, d, "m_peaks").selectExpr("chrom", "st", "en", "pid", "'.' score", "case when pid % 2 = 0 then '+' else '-' end strand")
    return readers.read_intervals(spark, _text(rows, "intervals")).select("id", "chrom", "st", "en", "strand")


@_add("s6_read_track", duck("select chrom, st, en, round(score, 6) score from m_track", "m_track"))
def s6(spark, d):
    return readers.read_track(spark, _text(view(spark, d, "m_track"), "track")).withColumn("score", r("score"))


@_add("s4_read_sequence", duck("select doc_id::varchar chrom, unnest(range(0, length(seq), 200)) chunk_start, substr(seq, chunk_start + 1, 220) seq from m_seq", "m_seq"))
def s4(spark, d):
    path = f"{shared_dir(spark)}/sequence-{uuid.uuid4().hex}"
    view(spark, d, "m_seq").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" a record\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.text(path)
    return readers.read_sequence(spark, path, 200, 20)


_PLACED = "block * 10 st0, length(text) n, case when block % 2 = 1 then '-' else '+' end strand, block * 10 + length(text) + 1000 src_size"


@_add("s5_read_alignments", duck(f"with p as (select *, {_PLACED} from m_rows where text <> ''), q as (select *, case when strand = '-' then src_size - st0 - n else st0 end st from p) select species, 'c' || block chrom, st, st + n en, strand, src_size, text, count(*) over (partition by block) in_block from q", "m_rows"))
def s5(spark, d):
    rows = view(spark, d, "m_rows").where("text <> ''").selectExpr("block", "species", "text", *_PLACED.split(", ", 1)[:1], "length(text) n", "case when block % 2 = 1 then '-' else '+' end strand", "block * 10 + length(text) + 1000 src_size")
    line = F.concat_ws(" ", F.lit("s"), F.concat("species", F.lit(".c"), F.col("block").cast("string")), *[F.col(c).cast("string") for c in ("st0", "n", "strand", "src_size", "text")])
    blocks = rows.groupBy("block").agg(F.concat(F.lit("a score=0\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n")).alias("value"))  # a row per species
    path = f"{shared_dir(spark)}/alignments-{uuid.uuid4().hex}"
    blocks.select("value").write.text(path)
    out = readers.read_alignments(spark, path)
    return out.withColumn("in_block", F.count("*").over(Window.partitionBy("block"))).drop("block")


@_add("s1_read_counts", duck("select 's' sample, cell::varchar cell, feature::varchar feature, x from m_counts", "m_counts"))
def s1(spark, d):
    counts = materialize(view(spark, d, "m_counts").select("cell", "feature", "x"), "triplets")
    number = lambda c, n: running_totals(counts.select(c).distinct().withColumns({"_k": F.lit(0), "_one": F.lit(1)}), ["_k"], [c], "_one", n).select(c, (F.col(n) + 1).alias(n))
    cells, features = [materialize(number(c, n), "numbered") for c, n in (("cell", "j"), ("feature", "i"))]
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    for name, rows in (("cell", cells), ("feature", features)):
        rows.orderBy(name).select(F.concat(F.col(name).cast("string"), F.lit("\tname")).alias("value")).write.text(f"{path}/{name}")
    body = counts.join(cells, "cell").join(features, "feature").select("i", "j", F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("x").cast("string")).alias("value"))
    sizes = counts.agg(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.concat_ws(" ", F.countDistinct("feature").cast("string"), F.countDistinct("cell").cast("string"), F.count("*").cast("string")).alias("value"))
    body.unionByName(sizes).orderBy("i", "j").select("value").write.text(f"{path}/matrix")
    return readers.read_counts(spark, f"{path}/matrix", f"{path}/cell", f"{path}/feature", "s")


_BASES = "select 'm' || (doc_id % 10) motif, pos, substr(seq, pos + 1, 1) base from m_seq, (select unnest(range(6))::int pos) where length(seq) > 6"


@_add("s7_read_pwm", duck(f"with b as ({_BASES}) select m.motif, p.pos, x.base, count(b.base)::double w from (select distinct motif from b) m, (select distinct pos from b) p, (select unnest(['A', 'C', 'G', 'T']) base) x left join b on b.motif = m.motif and b.pos = p.pos and b.base = x.base group by all", "m_seq"))
def s7(spark, d):
    rows = view(spark, d, "m_seq").where("length(seq) > 6").select(F.concat(F.lit("m"), (F.col("doc_id") % 10).cast("string")).alias("motif"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"), "seq")
    base = F.substring("seq", F.col("pos") + 1, F.lit(1))
    lines = rows.groupBy("motif", "pos").agg(F.concat_ws(" ", *[F.count(F.when(base == b, 1)).cast("string") for b in "ACGT"]).alias("line"))
    text = lines.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("rows"))  # six lines each
    path = f"{shared_dir(spark)}/pwm-{uuid.uuid4().hex}"
    text.select(F.concat(F.lit(">"), "motif", F.lit(" made of counts\n"), "rows").alias("value")).write.text(path)
    return readers.read_pwm(spark, path)


@_add("s8_write_table", duck("select pid, chrom, st, en from m_peaks", "m_peaks"))
def s8(spark, d):
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    readers.write_table(view(spark, d, "m_peaks"), path, ["chrom"], files=4)
    return spark.read.parquet(path).select("pid", "chrom", "st", "en")
