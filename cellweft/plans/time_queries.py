"""Queries over orderings, trends, sequences and alignments, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.operators import alignment as X
from cellweft.operators import motifs as M
from cellweft.operators import network as N
from cellweft.operators import timing as T
from cellweft.operators.tables import materialize
from cellweft.plans.views import duck, duck_pwm, literal_pwm, r, view

Q: dict = {}
SQL: dict = {}


def _add(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _knn(spark, d):
    return materialize(N.knn(view(spark, d, "m_emb"), 10), "knn")


@_add("t1_geodesic")
def t1(spark, d):
    return T.pseudotime_geodesic(_knn(spark, d), view(spark, d, "m_emb").where("cell = 0")).withColumn("t", r("t"))


@_add("t2_diffusion")
def t2(spark, d):
    return T.pseudotime_diffusion(_knn(spark, d), 0).withColumn("t", r("t"))


_PHASE = "ph as (select cell, sample, fmod(atan2(vec[2]::double, vec[1]::double) + 2 * pi(), 2 * pi()) phase from m_emb)"


@_add("t3_cyclic_phase", duck(f"with {_PHASE} select sample, round(fmod(atan2(avg(sin(phase)), avg(cos(phase))) + 2 * pi(), 2 * pi()), 6) mean, round(sqrt(pow(avg(sin(phase)), 2) + pow(avg(cos(phase)), 2)), 6) length from ph group by sample", "m_emb"))
def t3(spark, d):
    emb = view(spark, d, "m_emb")
    ph = T.cyclic_phase(emb, 0, 1).join(emb.select("cell", "sample"), "cell")
    return T.circular_mean(ph, "sample").withColumns({"mean": r("mean"), "length": r("length")})


@_add("t4_bin_time", duck(f"with {_PHASE} select cell, round(phase, 6) t, greatest(least(floor(phase * 12 / (2 * pi()))::int, 11), 0) bin, (ntile(8) over (order by phase, cell) - 1)::int part from ph", "m_emb"))
def t4(spark, d):
    ph = T.cyclic_phase(view(spark, d, "m_emb"), 0, 1).withColumnRenamed("phase", "t")
    equal = T.bin_time(ph, 8, "count").select("cell", F.col("bin").alias("part"))
    return T.bin_time(ph, 12).join(equal, "cell").withColumn("t", r("t"))


@_add("t5_smooth_trend", duck("with c as (select feature, bin, y, true own from m_trend union all select feature, bin - 30, y, false from m_trend where bin - 30 >= -2 union all select feature, bin + 30, y, false from m_trend where bin + 30 < 32), s as (select *, avg(y) over (partition by feature order by bin range between 2 preceding and 2 following) z from c) select feature, bin, round(z, 6) y from s where own", "m_trend"))
def t5(spark, d):
    return T.smooth_trend(view(spark, d, "m_trend"), 2, 30).withColumn("y", r("y"))


_HOURS = "select event_type feature, ({sec} % 86400) / cast(3600 as double) t, value y from events"


@_add(
    "t5_kernel_trend",
    "with e as (" + _HOURS.format(sec="(floor(epoch(ts) - epoch(timestamp '2024-01-01'))::bigint)") + """), s as (select feature, least(floor(t * 24 / 24), 23)::int f, sum(y) y, count(*) n from e where y is not null group by all),
w as (select i f, j bin, exp(-pow(least(abs(i - j), 24 - abs(i - j)), 2) / (2 * 1.5::double * 1.5)) w from range(24) a(i), range(24) b(j))
select feature, bin::int bin, bin + 0.5::double t, round(sum(w * y) / sum(w * n), 6) y from s join w using (f) group by feature, bin""",
)
def t5b(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = spark.sql(_HOURS.format(sec="timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").replace("from events", "from {events}"), events=events)
    return T.kernel_trend(rows, 24, 1.5, 24.0).withColumn("y", r("y"))


@_add("t6_time_association", duck("with k as (select feature, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0::double a, rank() over (partition by feature order by bin) + (count(*) over (partition by feature, bin) - 1) / 2.0::double b from m_trend) select feature, round(corr(a, b), 6) rho, count(*) n from k group by feature", "m_trend"))
def t6(spark, d):
    return T.time_association(view(spark, d, "m_trend")).withColumn("rho", r("rho"))


_DAYS = "select event_type feature, cast({day} as int) bin, value y from events"


@_add("t6_bin_association", "with x as (" + _DAYS.format(day="floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 86400)") + """), p as (select feature, bin, count(*) n, avg(y) m, var_pop(y) v from x where y is not null group by all),
a as (select feature, sum(n)::bigint n, count(*) bins, sum(n * m) / sum(n) mm, sum(n * v) ss from p group by 1)
select feature, any_value(a.n) n, any_value(bins) bins, round(sum(p.n * pow(m - mm, 2)) / any_value(bins - 1) / any_value(ss / (a.n - bins)), 6) f from p join a using (feature) group by feature""")
def t6b(spark, d):
    rows = spark.sql(_DAYS.format(day="timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 86400").replace("from events", "from {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    return T.bin_association(rows).withColumn("f", r("f"))


@_add("t7_stage_summary", duck(f"with {_PHASE}, s as (select sample stage, quantile_cont(phase, 0.5) median, quantile_cont(phase, 0.75) - quantile_cont(phase, 0.25) iqr from ph group by 1) select stage, round(median, 6) median, round(iqr, 6) iqr, dense_rank() over (order by median)::int place from s", "m_emb"))
def t7(spark, d):
    emb = view(spark, d, "m_emb")
    pt = T.cyclic_phase(emb, 0, 1).withColumnRenamed("phase", "t")
    return T.stage_summary(pt, emb.select("cell", F.col("sample").alias("stage"))).withColumns({"median": r("median"), "iqr": r("iqr")})


_PEAK = "pk as (select feature, arg_min(bin, bin) filter (y = top) peak, min(bin) filter (y >= (top + low) / 2) onset from (select *, max(y) over (partition by feature) top, min(y) over (partition by feature) low from m_trend) group by feature)"


@_add("t8_peak_time", duck(f"with {_PEAK} select * from pk", "m_trend"))
def t8(spark, d):
    return T.peak_time(view(spark, d, "m_trend"))


@_add("t9_lag", duck("""with p as (select a.feature fa, b.feature fb, unnest(range(-5, 6))::int "lag" from (select distinct feature from m_trend) a, (select distinct feature from m_trend) b where a.feature < b.feature),
c as (select fa, fb, "lag", round(corr(x.y, z.y), 9) corr, count(*) n from p join m_trend x on x.feature = fa join m_trend z on z.feature = fb and z.bin = x.bin + "lag" group by all),
k as (select *, row_number() over (partition by fa, fb order by corr desc nulls last, abs("lag"), "lag") k from c where n >= 5) select fa, fb, "lag", round(corr, 6) corr from k where k = 1""", "m_trend"))
def t9(spark, d):
    t = view(spark, d, "m_trend")
    f = t.select("feature").distinct()
    pairs = f.select(F.col("feature").alias("fa")).join(f.select(F.col("feature").alias("fb")), F.col("fa") < F.col("fb"))
    return T.lag(t, t, pairs, 5).withColumn("corr", r("corr"))


@_add("t10_order_elements", duck(f"""with {_PEAK}, o as (select feature, onset, percent_rank() over (order by onset) pr, lag(feature) over (order by onset, feature) before, onset - lag(onset) over (order by onset, feature) gap from pk)
select feature, onset, round(pr, 6) rank, case when pr < 1 / 3 then 'early' when pr < 2 / 3 then 'middle' else 'late' end kind, before, gap from o""", "m_trend"))
def t10(spark, d):
    return T.order_elements(T.peak_time(view(spark, d, "m_trend")))


@_add("t10_asof", "select l.event_id, r.value from (select * from events where event_type = 'purchase') l asof left join (select user_id, ts, max(value) value from events where event_type = 'view' group by 1, 2) r on l.user_id = r.user_id and l.ts >= r.ts")
def t10b(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return T.asof_join(left, right, "user_id", "ts", "value").select("event_id", "value")


_PFM = "pfm as (select p_type motif, p_size % 6 pos, case p_partkey % 4 when 0 then 'A' when 1 then 'C' when 2 then 'G' else 'T' end base, count(*) n from part group by all)"


@_add("m1_pwm_from_counts", f"with {_PFM} select motif, pos, base, round(log2((n + 0.5) / sum(n + 0.5) over (partition by motif, pos) / 0.25), 6)::double w from pfm")
def m1(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    pfm = part.groupBy(F.col("p_type").alias("motif"), (F.col("p_size") % 6).alias("pos"), F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("base")).agg(F.count("*").alias("n"))
    return M.pwm_from_counts(pfm).withColumn("w", r("w"))


# intervals of 40 bases tile every whole sequence
_GENOME = "g as (select doc_id chrom, seq from m_seq), iv as (select doc_id * 100000 + k id, doc_id chrom, 40 * k st, least(40 * k + 40, n) en, case when k % 2 = 0 then '+' else '-' end strand from (select doc_id, length(seq) n, unnest(range((length(seq) + 39) // 40)) k from m_seq))"


def _genome(spark, d):
    g = view(spark, d, "m_seq")
    chunks = g.select(F.col("doc_id").alias("chrom"), F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,50}"), F.lit(0))).alias("k", "seq")).select("chrom", (F.col("k") * 50).cast("long").alias("chunk_start"), "seq")
    iv = g.where("seq <> ''").select("doc_id", F.char_length("seq").alias("n"), F.explode(F.sequence(F.lit(0), F.expr("(length(seq) - 1) div 40"))).alias("k"))
    iv = iv.selectExpr("doc_id * 100000 + k id", "doc_id chrom", "cast(40 * k as bigint) st", "cast(least(40 * k + 40, n) as bigint) en", "case when k % 2 = 0 then '+' else '-' end strand")
    return iv, chunks


@_add("m2_interval_sequence", duck(f"with {_GENOME} select id, case when strand = '-' then translate(reverse(substr(seq, st + 1, en - st)), 'ACGT', 'TGCA') else substr(seq, st + 1, en - st) end seq from iv join g using (chrom)", "m_seq"))
def m2(spark, d):
    return M.interval_sequence(*_genome(spark, d), 50)


@_add("m3_revcomp", duck("select doc_id, translate(reverse(seq), 'ACGT', 'TGCA') seq from m_seq", "m_seq"))
def m3(spark, d):
    return view(spark, d, "m_seq").select("doc_id", M.revcomp(F.col("seq")).alias("seq"))


_SCAN = f"""{duck_pwm()}, win as (select doc_id id, unnest(range(length(seq) - 3)) start, seq from m_seq where length(seq) >= 4),
st as (select id, start, '+' strand, substr(seq, start + 1, 4) word from win union all select id, start, '-', translate(reverse(substr(seq, start + 1, 4)), 'ACGT', 'TGCA') from win),
words as (select distinct word from st), sc as (select word, motif, sum(w) score from words join pwm on substr(word, pos + 1, 1) = base group by 1, 2 having sum(w) >= 4.5),
hits as (select id, motif, start::int start, strand, score from st join sc using (word))"""


def _hits(spark, d):
    return M.motif_scan(view(spark, d, "m_seq").select(F.col("doc_id").alias("id"), "seq"), literal_pwm(spark), 4.5)


@_add("m4_motif_scan", duck(f"with {_SCAN} select * from hits", "m_seq"))
def m4(spark, d):
    return _hits(spark, d)


@_add("m5_gc_content", duck("select doc_id id, length(seq) length, round((length(seq) - length(translate(seq, 'GC', ''))) / nullif(length(seq), 0), 6) gc from m_seq", "m_seq"))
def m5(spark, d):
    return M.gc_content(view(spark, d, "m_seq").select(F.col("doc_id").alias("id"), "seq")).withColumns({"gc": r("gc"), "length": F.col("length").cast("long")})


@_add("m5_kmer_counts", duck("select kmer, count(*) n from (select substr(seq, unnest(range(1, length(seq) - 3)), 5) kmer from m_seq where length(seq) >= 5) group by 1", "m_seq"))
def m5b(spark, d):
    return M.kmer_counts(view(spark, d, "m_seq"), 5)


def _sides(spark, d):
    gc = M.gc_content(view(spark, d, "m_seq").select(F.col("doc_id").alias("id"), "seq"))
    fg = gc.where("id % 4 = 0")
    return fg, M.matched_background(fg, gc, 1)


@_add("m6_matched_background")
def m6(spark, d):
    return _sides(spark, d)[1].withColumn("gc", r("gc"))


_LC = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@_add(
    "m7_motif_enrichment",
    duck(
        f"""with {_SCAN}, k as (select motif, count(distinct id) filter (id % 4 = 0) kf, count(distinct id) filter (id % 4 <> 0) kb from hits group by 1),
t as (select count(*) filter (doc_id % 4 = 0) nf, count(*) filter (doc_id % 4 <> 0) nb from m_seq),
p as (select motif, sum(exp({_LC.format(n="(kf + kb)", k="i")} + {_LC.format(n="(nf + nb - kf - kb)", k="(nf - i)")} - {_LC.format(n="(nf + nb)", k="nf")})) p from (select *, unnest(range(greatest(kf, nf + kf + kb - nf - nb), least(kf + kb, nf) + 1)) i from k, t) group by 1)
select motif, kf k_fg, nf n_fg, kb k_bg, nb n_bg, round((kf + 0.5) * (nb - kb + 0.5) / ((kb + 0.5) * (nf - kf + 0.5)), 6)::double odds, round(least(p, 1), 6) p from k join p using (motif), t""",
        "m_seq",
    ),
)
def m7(spark, d):
    ids = view(spark, d, "m_seq").select(F.col("doc_id").alias("id"))
    return M.motif_enrichment(_hits(spark, d), ids.where("id % 4 = 0"), ids.where("id % 4 <> 0")).withColumns({"odds": r("odds"), "p": r("p")})


@_add(
    "m8_motif_deviation",
    duck(
        """with c as (select feature, cell, x from m_counts),
s as (select set_id motif, -1 draw, feature from m_sets union select set_id, k, (feature + k * 37) % (select max(feature) from m_sets) + 1 from m_sets, (select unnest(range(5)) k)),
ct as (select cell, sum(x) ct from c group by 1), ft as (select feature, sum(x) ft from c group by 1), tot as (select sum(x) t from c),
st as (select motif, draw, sum(ft) st from s join ft using (feature) group by 1, 2), o as (select cell, motif, draw, sum(x) o from c join s using (feature) group by all),
dv as (select cell, motif, draw, (coalesce(o, 0) - ct * st / t) / (ct * st / t) dev from st cross join ct cross join tot left join o using (cell, motif, draw)),
nul as (select cell, motif, avg(dev) m, stddev_samp(dev) sd from dv where draw >= 0 group by 1, 2)
select cell, motif, round(dev, 5) dev, round((dev - m) / nullif(sd, 0), 4) z from dv join nul using (cell, motif) where draw = -1""",
        "m_counts",
        "m_sets",
    ),
)
def m8(spark, d):
    sets = view(spark, d, "m_sets")
    top = sets.agg(F.max("feature")).first()[0]
    bg = sets.select(F.col("set_id").alias("motif"), "feature", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("draw")).withColumn("feature", (F.col("feature") + F.col("draw") * 37) % top + 1)
    out = M.motif_deviation(view(spark, d, "m_counts"), sets.withColumnRenamed("set_id", "motif"), bg)
    return out.withColumns({"dev": r("dev", 5), "z": r("z", 4)})


@_add(
    "m11_conserved_enrichment",
    duck(
        f"""with s as (select pid, sum(score * (least(p.en, t.en) - greatest(p.st, t.st))) / sum(least(p.en, t.en) - greatest(p.st, t.st)) m from m_peaks p join m_track t on p.chrom = t.chrom and p.st < t.en and t.st < p.en group by 1),
k as (select count(*) filter (pid % 4 = 0 and m >= 5000) kf, count(*) filter (pid % 4 = 0) nf, count(*) filter (pid % 4 <> 0 and m >= 5000) kb, count(*) filter (pid % 4 <> 0) nb from m_peaks left join s using (pid)),
p as (select sum(exp({_LC.format(n="(kf + kb)", k="i")} + {_LC.format(n="(nf + nb - kf - kb)", k="(nf - i)")} - {_LC.format(n="(nf + nb)", k="nf")})) p from (select *, unnest(range(greatest(kf, nf + kf + kb - nf - nb), least(kf + kb, nf) + 1)) i from k))
select kf k_fg, nf n_fg, kb k_bg, nb n_bg, round((kf + 0.5) * (nb - kb + 0.5) / ((kb + 0.5) * (nf - kf + 0.5)), 6)::double odds, round(least(p, 1), 6) p from k, p""",
        "m_peaks",
        "m_track",
    ),
)
def m11(spark, d):
    p = view(spark, d, "m_peaks")
    out = M.conserved_enrichment(p.where("pid % 4 = 0"), p.where("pid % 4 <> 0"), view(spark, d, "m_track"), 5000.0)
    return out.withColumns({"odds": r("odds"), "p": r("p")})


_LIFT = """lo as (select p.pid id, dst_chrom, dst_strand, chain, en - st len, greatest(st, src_start) a, least(en, src_end) b, src_start, src_end, dst_start from m_peaks p join m_blocks k on p.chrom = k.src_chrom and st < src_end and src_start < en),
lg as (select *, case when dst_strand = '+' then dst_start + a - src_start else dst_start + src_end - b end lo from lo),
lifted as (select id, dst_chrom, dst_strand, chain, min(lo) dst_st, max(lo + b - a) dst_en, round(sum(b - a) / any_value(len), 6) frac from lg group by 1, 2, 3, 4)"""


def _iv(spark, d):
    return view(spark, d, "m_peaks").withColumnRenamed("pid", "id")


def _lifted(spark, d):
    return X.lift(_iv(spark, d), view(spark, d, "m_blocks")).withColumn("frac", r("frac"))


@_add("x1_lift", duck(f"with {_LIFT} select * from lifted", "m_peaks", "m_blocks"))
def x1(spark, d):
    return _lifted(spark, d)


@_add("x2_lift_filter", duck(f"with {_LIFT}, n as (select id, count(*) n, max(frac) frac from lifted group by 1) select pid id, frac, case when n is null then 'deleted' when frac < 0.9 then 'partial' when n > 1 then 'split' else 'mapped' end kind from m_peaks left join n on id = pid", "m_peaks", "m_blocks"))
def x2(spark, d):
    return X.lift_filter(_iv(spark, d), _lifted(spark, d), 0.9)


# Blocks of every third chain lead back seven bases off, so that their intervals do not come home.
_SHIFT = "case when chain % 3 = 0 then 7 else 0 end"


@_add(
    "x3_reciprocal",
    duck(
        f"""with {_LIFT}, there as (select id, dst_chrom chrom, dst_st st, dst_en en from lifted where frac >= 1),
back as (select dst_chrom k_chrom, dst_start + {_SHIFT} k0, dst_end + {_SHIFT} k1, src_chrom t_chrom, src_start t0, dst_strand strand, chain from m_blocks),
bo as (select id, t_chrom, strand, chain, greatest(st, k0) a, least(en, k1) b, k0, k1, t0 from there join back on chrom = k_chrom and st < k1 and k0 < en),
bg as (select *, case when strand = '+' then t0 + a - k0 else t0 + k1 - b end lo from bo),
home as (select id, t_chrom chrom, min(lo) st, max(lo + b - a) en from bg group by id, t_chrom, strand, chain)
select pid id, p.chrom, p.st, p.en from m_peaks p where exists (from home h where h.id = pid and h.chrom = p.chrom and h.st = p.st and h.en = p.en)""",
        "m_peaks",
        "m_blocks",
    ),
)
def x3(spark, d):
    b = view(spark, d, "m_blocks")
    back = X.invert(b).withColumns({c: F.col(c) + F.expr(_SHIFT) for c in ("src_start", "src_end")})
    return X.reciprocal(_iv(spark, d), b, back).select("id", "chrom", "st", "en")


_OTHER = "other as (select pid, 'd' || (pid % 5) chrom, st % 600000 st, st % 600000 + en - st en from m_peaks)"


@_add("x4_ortholog_elements", duck(f"with {_LIFT}, {_OTHER}, j as (select id, pid, least(dst_en, en) - greatest(dst_st, st) overlap, abs(dst_st + dst_en - st - en) far from lifted join other on chrom = dst_chrom and dst_st < en and st < dst_en), k as (select *, row_number() over (partition by id order by overlap desc, far, pid) k from j) select id, pid, overlap from k where k = 1", "m_peaks", "m_blocks"))
def x4(spark, d):
    other = view(spark, d, "m_peaks").selectExpr("pid", "concat('d', pid % 5) chrom", "st % 600000 st", "st % 600000 + en - st en")
    return X.ortholog_elements(_lifted(spark, d), other)


_COLS = "ac as (select block, species, unnest(range(length(text))) col, text from m_rows), cols as (select block, species, col::int col, substr(text, col + 1, 1) base from ac)"


@_add("x5_align_identity", duck(f"with {_COLS} select c.block, c.species, count(*) n, count(*) filter (c.base = '-' or a.base = '-') gaps, round(count(*) filter (c.base = a.base and c.base <> '-') / nullif(count(*) filter (c.base <> '-' and a.base <> '-'), 0), 6) identity from cols c join cols a on a.block = c.block and a.col = c.col and a.species = '0' where c.species <> '0' group by 1, 2", "m_rows"))
def x5(spark, d):
    return X.align_identity(view(spark, d, "m_rows"), "0").withColumn("identity", r("identity"))


@_add("x6_align_runs", duck(f"with {_COLS}, s as (select block, col from cols group by 1, 2 having count(*) > 1 and min(base) = max(base) and min(base) <> '-'), i as (select *, col - row_number() over (partition by block order by col) i from s) select block, min(col) st, max(col) + 1 en from i group by block, i having max(col) + 1 - min(col) >= 3", "m_rows"))
def x6(spark, d):
    return X.align_runs(view(spark, d, "m_rows"), 3)


@_add("x7_project_positions", duck(f"with {_COLS} select block, col, case when base <> 'A' then sum((base <> 'A')::int) over (partition by block order by col) - 1 end::bigint pos from cols where species = '1'", "m_rows"))
def x7(spark, d):
    rows = view(spark, d, "m_rows").withColumn("text", F.translate("text", "A", "-"))  # no gaps in the stand-in, so A plays one
    return X.project_positions(rows, "1").withColumn("pos", F.col("pos").cast("long"))


@_add("x8_kmer_similarity", duck("""with k as (select distinct doc_id id, substr(seq, unnest(range(1, length(seq) - 10)), 12) kmer from m_seq where length(seq) >= 12), n as (select id, count(*) n from k group by 1),
c as (select x.id a, y.id b, count(*) c from k x join k y using (kmer) where x.id < y.id group by 1, 2)
select a, b, round(c / (x.n + y.n - c), 6) jaccard from c join n x on x.id = a join n y on y.id = b where c / (x.n + y.n - c) >= 0.8""", "m_seq"))
def x8(spark, d):
    return X.kmer_similarity(view(spark, d, "m_seq").select(F.col("doc_id").alias("id"), "seq"), 12, 0.8).withColumn("jaccard", r("jaccard"))


@_add("x8_kmer_sketch")
def x8b(spark, d):
    return X.kmer_similarity(view(spark, d, "m_seq").select(F.col("doc_id").alias("id"), "seq"), 12, 0.8, sketch=64).withColumn("jaccard", r("jaccard"))


@_add("x9_motif_turnover", duck(f"""with {_LIFT}, mt as (select pid id, pid % 3 motif from m_peaks), {_OTHER.replace("select pid,", "select pid id, pid % 3 motif,")},
pr as (select l.id, o.id other from lifted l join mt on mt.id = l.id join other o on o.chrom = dst_chrom and o.motif = mt.motif and dst_st - 50 < o.en and o.st < dst_en + 50)
select pid id, case when pid in (select id from pr) then 'kept' else 'lost' end state from m_peaks union all select id, 'gained' from other where id not in (select other from pr)""", "m_peaks", "m_blocks"))
def x9(spark, d):
    here = view(spark, d, "m_peaks").selectExpr("pid id", "pid % 3 motif", "chrom", "st", "en")
    there = view(spark, d, "m_peaks").selectExpr("pid id", "pid % 3 motif", "concat('d', pid % 5) chrom", "st % 600000 st", "st % 600000 + en - st en")
    return X.motif_turnover(here, there, view(spark, d, "m_blocks"), 50)

