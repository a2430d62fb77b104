"""Queries over counts, fragments and intervals, with their SQL."""

from __future__ import annotations

from cellweft.operators import cells as C
from cellweft.operators import intervals as IV
from cellweft.operators import sweep as SW
from cellweft.plans.views import duck, r, view

Q: dict = {}
SQL: dict = {}


def _add(name, sql):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


@_add("q1_cell_qc", duck("select sample, cell, sum(c.x) total, count(*) filter (c.x > 0) n_features, round(coalesce(sum(c.x) filter (s.feature is not null), 0) / sum(c.x), 6) frac from m_counts c left join (select feature from m_sets where set_id = 'PROMO') s using (feature) group by all", "m_counts", "m_sets"))
def q1(spark, d):
    sets = view(spark, d, "m_sets").where("set_id = 'PROMO'")
    return C.cell_qc(view(spark, d, "m_counts"), sets).withColumn("frac", r("frac"))


@_add("q2_feature_qc", duck("select feature, count(*) filter (x > 0) n_cells, round(sum(x) / (select count(distinct cell) from m_counts), 6) mean from m_counts group by feature", "m_counts"))
def q2(spark, d):
    return C.feature_qc(view(spark, d, "m_counts")).withColumn("mean", r("mean"))


@_add("q3_filter_cells", duck("select * from m_counts where cell in (select cell from m_counts group by cell, sample having sum(x) >= 80 and count(*) >= 3)", "m_counts"))
def q3(spark, d):
    return C.filter_cells(view(spark, d, "m_counts"), 80, 3).select("sample", "cell", "feature", "x")


@_add("q4_filter_mad", duck("with t as (select sample, cell, sum(x) total from m_counts group by all), m as (select *, abs(total - median(total) over (partition by sample)) dev from t), k as (select *, median(dev) over (partition by sample) mad from m) select sample, cell, total from k where dev <= 1 * 1.4826::double * mad", "m_counts"))
def q4(spark, d):
    return C.filter_mad(C.cell_qc(view(spark, d, "m_counts")).select("sample", "cell", "total"), "total", 1, "sample")


@_add("q5_paired_cells", duck("select cell, case when a.cell is not null and b.cell is not null then 'both' when a.cell is not null then 'rna' else 'atac' end seen from (select distinct cell from m_counts) a full join (select distinct cell from m_frag) b using (cell)", "m_counts", "m_frag"))
def q5(spark, d):
    return C.paired_cells(view(spark, d, "m_counts"), view(spark, d, "m_frag"))


_TWICE = "(select cell, chrom, st - st % 600 st, en - en % 600 + 600 en from m_frag)"


@_add("q6_dedup_fragments", duck(f"select cell, chrom, st, en, count(*) n from {_TWICE} group by all", "m_frag"))
def q6(spark, d):
    return IV.dedup_fragments(view(spark, d, "m_frag").selectExpr("cell", "chrom", "st - st % 600 st", "en - en % 600 + 600 en"))


@_add("q7_frag_length_hist", duck("select cell, (en - st >= 100)::int + (en - st >= 200)::int + (en - st >= 400)::int cls, count(*) n from m_frag group by all", "m_frag"))
def q7(spark, d):
    return IV.frag_length_hist(view(spark, d, "m_frag"), [100, 200, 400])


_OV = "a.chrom = b.chrom and a.st < b.en and b.st < a.en"


@_add("q8_interval_join", duck(f"select a.fid, b.pid b_pid, least(a.en, b.en) - greatest(a.st, b.st) overlap from m_frag a join m_peaks b on {_OV}", "m_frag", "m_peaks"))
def q8(spark, d):
    return IV.interval_join(view(spark, d, "m_frag"), view(spark, d, "m_peaks")).select("fid", "b_pid", IV.overlap_length().alias("overlap"))


@_add("q9_count_in_intervals", duck(f"select a.cell, b.pid, count(*) x from m_frag a join m_peaks b on {_OV} group by all", "m_frag", "m_peaks"))
def q9(spark, d):
    return SW.count_pairs(view(spark, d, "m_frag"), view(spark, d, "m_peaks"))


@_add("q10_frac_in_peaks", duck(f"with hit as (select distinct a.fid from m_frag a join m_peaks b on {_OV}) select cell, count(*) n, count(h.fid) n_in, round(count(h.fid) / count(*), 6) frac from m_frag f left join hit h using (fid) group by cell", "m_frag", "m_peaks"))
def q10(spark, d):
    return IV.frac_in_peaks(view(spark, d, "m_frag"), view(spark, d, "m_peaks")).withColumn("frac", r("frac"))


@_add("q11_tss_enrichment", duck("with p as (select cell, abs((st + en) // 2 - tss) dist from m_frag f join m_tss t on f.chrom = t.chrom and (st + en) // 2 between tss - 2000 and tss + 2000), s as (select cell, sum((dist <= 200)::int) centre, sum((dist > 1800)::int) flank from p group by cell) select cell, centre::bigint centre, flank::bigint flank, round(case when flank > 0 then (centre / 401) / (flank / 400) end, 6) ratio from s", "m_frag", "m_tss"))
def q11(spark, d):
    return IV.tss_enrichment(view(spark, d, "m_frag"), view(spark, d, "m_tss")).withColumn("ratio", r("ratio"))


@_add("q12_tile_counts", duck("select cell, chrom, st // 5000 * 5000 tile, count(*) x from m_frag group by all", "m_frag"))
def q12(spark, d):
    return IV.tile_counts(view(spark, d, "m_frag"), 5000)


@_add("q13_merge_intervals", duck("with a as (select *, case when st <= max(en) over (partition by chrom order by st, en rows between unbounded preceding and 1 preceding) then 0 else 1 end n0 from m_peaks), b as (select *, sum(n0) over (partition by chrom order by st, en rows unbounded preceding) island from a) select chrom, min(st) st, max(en) en, count(*) n from b group by chrom, island", "m_peaks"))
def q13(spark, d):
    return IV.merge_intervals(view(spark, d, "m_peaks"))


@_add("q7_frag_length_ratio", duck("select cell, count(*) filter (en - st < 150) n_short, count(*) filter (en - st >= 150) n_long, round(n_short / nullif(n_long, 0), 6) ratio from m_frag group by cell", "m_frag"))
def q7b(spark, d):
    return IV.frag_length_ratio(view(spark, d, "m_frag"), 150).withColumn("ratio", r("ratio"))


_NORM = "norm as (select sample, cell, feature, ln(1 + x / sum(x) over (partition by cell) * 10000) x from m_counts)"


@_add("q14_lognorm", duck(f"with {_NORM} select sample, cell, feature, round(x, 6) x from norm", "m_counts"))
def q14(spark, d):
    return C.lognorm(view(spark, d, "m_counts")).withColumn("x", r("x"))


@_add("q15_tfidf", duck("with df as (select feature, count(*) df from m_counts where x > 0 group by 1) select cell, feature, round(ln(1 + x / sum(x) over (partition by cell) * (select count(distinct cell) from m_counts) / df * 10000), 6) x from m_counts join df using (feature)", "m_counts"))
def q15(spark, d):
    return C.tfidf(view(spark, d, "m_counts")).withColumn("x", r("x"))


_MOM = f"{_NORM}, n as (select count(distinct cell) n from norm), mom as (select feature, sum(x) / n mean, (sum(x * x) - n * (sum(x) / n) * (sum(x) / n)) / (n - 1) var, n from norm, n group by feature, n)"


@_add("q16_hvg", duck(f"with {_MOM}, b as (select *, ntile(10) over (order by mean, feature) bin from mom), z as (select *, round(coalesce((var - avg(var) over (partition by bin)) / nullif(stddev_samp(var) over (partition by bin), 0), 0), 9) z from b), k as (select *, row_number() over (order by z desc, feature) rank from z) select feature, round(mean, 6) mean, round(var, 6) var, bin::int bin, round(z, 5) z, rank::int rank from k where rank <= 50", "m_counts"))
def q16(spark, d):
    out = C.hvg(C.lognorm(view(spark, d, "m_counts")), 50)
    return out.withColumns({"mean": r("mean"), "var": r("var"), "z": r("z", 5)})


@_add("i1_scale", duck(f"with {_MOM} select cell, feature, round((x - mean) / sqrt(nullif(var, 0)), 6) x from norm join mom using (feature)", "m_counts"))
def i1(spark, d):
    return C.scale(C.lognorm(view(spark, d, "m_counts"))).withColumn("x", r("x"))


@_add("i10_rank_markers", duck(f"""with {_NORM}, g as (select cell, cell_type grp from m_cells), sz as (select grp, count(*) m from g group by 1), own as (select norm.cell, feature, x, grp from norm join g using (cell)),
rk as (select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0::double r from own),
ful as (select feature, count(*) c, sum(x) s from rk group by 1), tied as (select feature, sum(t * t * t - t)::double ties from (select feature, x, count(*)::double t from rk group by 1, 2) group by 1),
gr as (select feature, grp, count(*) k, sum(x) gs, sum(r) gr from rk group by 1, 2), j as (select *, (select count(*) from g) n from gr join ful using (feature) join tied using (feature) join sz using (grp)),
s as (select *, n - c zeros, n - m rest, ties + pow((n - c)::double, 3) - (n - c) tt, gr + k * (n - c) + (m - k) * (n - c + 1) / 2.0::double ranks from j),
o as (select grp, feature, round(k / m, 9) detected, round(log2(gs / m + 1e-9::double) - log2((case when rest > 0 then (s - gs) / rest else 0 end) + 1e-9::double), 6) lfc,
round(case when rest > 0 and m * rest / 12.0::double * ((n + 1) - tt / (n * (n - 1.0::double))) > 0 then (ranks - m * (n + 1) / 2.0::double) / sqrt(m * rest / 12.0::double * ((n + 1) - tt / (n * (n - 1.0::double)))) end, 6) z from s)
select grp, feature, detected, lfc, z, rank::int rank from (select *, row_number() over (partition by grp order by lfc desc, feature) rank from o) where rank <= 20""", "m_counts", "m_cells"))
def i10(spark, d):
    return C.rank_markers(C.lognorm(view(spark, d, "m_counts")), view(spark, d, "m_cells").selectExpr("cell", "cell_type grp"), 20)


@_add("i12_pseudobulk", duck("select feature, c.sample, cell_type, sum(x) x, count(*) cells, (grouping(c.sample) * 2 + grouping(cell_type))::int \"level\" from (select cell, feature, x from m_counts) t join m_cells c using (cell) group by feature, rollup (c.sample, cell_type)", "m_counts", "m_cells"))
def i12(spark, d):
    return C.pseudobulk(view(spark, d, "m_counts"), view(spark, d, "m_cells"))


@_add("i13_composition", duck("select stage, cell_type, count(*) n, round(count(*) / sum(count(*)) over (partition by stage), 6) share from m_cells group by stage, cell_type", "m_cells"))
def i13(spark, d):
    return C.composition(view(spark, d, "m_cells")).withColumn("share", r("share"))


@_add("g1_peak_gene_pairs", duck("select pid, gene, case when strand = '+' then (st + en) // 2 - tss else tss - (st + en) // 2 end distance from m_peaks p join m_tss t on p.chrom = t.chrom and (st + en) // 2 between tss - 10000 and tss + 10000", "m_peaks", "m_tss"))
def g1(spark, d):
    return IV.peak_gene_pairs(view(spark, d, "m_peaks"), view(spark, d, "m_tss"), 10000)


@_add("m9_interval_score", duck(f"with ov as (select a.pid, sum(score * (least(a.en, b.en) - greatest(a.st, b.st))) s, sum(least(a.en, b.en) - greatest(a.st, b.st)) cov from m_peaks a join m_track b on {_OV} group by 1) select p.pid, round(s / cov, 6) mean, round(coalesce(cov, 0) / (en - st), 6) share from m_peaks p left join ov using (pid)", "m_peaks", "m_track"))
def m9(spark, d):
    return IV.interval_score(view(spark, d, "m_peaks"), view(spark, d, "m_track")).withColumns({"mean": r("mean"), "share": r("share")})


@_add("m10_score_profile", duck("select floor((mid - st) * 20 / (en - st))::int part, round(avg(score), 6) mean, count(*) n from m_peaks p join (select chrom, (st + en) // 2 mid, score from m_track) t on p.chrom = t.chrom and mid >= st and mid < en group by 1", "m_peaks", "m_track"))
def m10(spark, d):
    return IV.score_profile(view(spark, d, "m_peaks"), view(spark, d, "m_track"), 20).withColumn("mean", r("mean"))


