"""Queries over neighbours, links and networks, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.operators import cells as C
from cellweft.operators import neighbours as NB
from cellweft.operators import network as N
from cellweft.operators import reduce as R
from cellweft.operators.tables import dealt, materialize
from cellweft.plans.views import duck, r, view

Q: dict = {}
SQL: dict = {}
K = 10


def _add(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_KNN = f"""d as (select a.cell a, b.cell b, list_distance(a.vec::double[], b.vec::double[]) distance from m_emb a join m_emb b on a.cell <> b.cell),
knn as (select * from (select *, row_number() over (partition by a order by distance, b) rank from d) where rank <= {K})"""


def _knn(spark, d):
    return materialize(N.knn(view(spark, d, "m_emb"), K), "knn")


def _selected(spark, d):
    x = C.lognorm(view(spark, d, "m_counts")).select("cell", "feature", "x")
    return x, C.hvg(x, 30).select("feature")


@_add("i2_pca")
def i2(spark, d):
    return R.pca(*_selected(spark, d), 5)


@_add("i3_lsi")
def i3(spark, d):
    x, selected = _selected(spark, d)
    return R.lsi(x, 5, selected)[0]


@_add("i4_knn", duck(f"with {_KNN} select a, b, round(distance, 6) distance, rank::int rank from knn", "m_emb"))
def i4(spark, d):
    return N.knn(view(spark, d, "m_emb"), K).withColumn("distance", r("distance"))


_MNN = "pairs as (select x.a, x.b from knn x join knn y on x.a = y.b and x.b = y.a join m_emb s on s.cell = x.a join m_emb t on t.cell = x.b where x.a < x.b and s.sample <> t.sample)"


@_add("i5_mnn_pairs", duck(f"with {_KNN}, {_MNN} select * from pairs", "m_emb"))
def i5(spark, d):
    return N.mnn_pairs(_knn(spark, d), view(spark, d, "m_emb"))


@_add(
    "i6_mnn_correct",
    duck(
        f"""with {_KNN}, {_MNN}, both_ as (select a, b from pairs union all select b, a from pairs),
diff as (select s.sample, s.vec::double[] va, list_transform(list_zip(t.vec, s.vec), lambda z: z[1]::double - z[2]::double) df from both_ p join m_emb s on s.cell = p.a join m_emb t on t.cell = p.b where t.sample = 0 and s.sample <> 0),
near as (select e.cell, exp(-pow(list_distance(e.vec::double[], va), 2) / (2 * 0.64::double)) w, df from m_emb e join diff using (sample)),
moved as (select cell, pos, sum(w * df[pos]) / sum(w) x from near, (select unnest(range(1, 65)) pos) group by all)
select e.cell, pos::int - 1 pos, round(e.vec[pos]::double + coalesce(m.x, 0), 5) x from m_emb e cross join (select unnest(range(1, 65)) pos) left join moved m using (cell, pos)""",
        "m_emb",
    ),
)
def i6(spark, d):
    emb = view(spark, d, "m_emb")
    out = N.mnn_correct(emb, N.mnn_pairs(_knn(spark, d), emb), 0, 0.8)
    return out.select("cell", F.posexplode("vec").alias("pos", "x")).withColumn("x", r("x", 5))


@_add("i7_centroid_correct")
def i7(spark, d):
    return N.centroid_correct(view(spark, d, "m_emb"), 5, 3)


@_add("i8_mixing_score", duck(f"with {_KNN}, n as (select a, sample, count(*)::double n from knn join m_emb on cell = b group by all), p as (select a, n / sum(n) over (partition by a) p from n) select a cell, round(-sum(p * ln(p)), 6) + 0.0 entropy, round(1 / sum(p * p), 6) simpson from p group by a", "m_emb"))
def i8(spark, d):
    return N.mixing_score(_knn(spark, d), view(spark, d, "m_emb")).withColumns({"entropy": r("entropy") + 0.0, "simpson": r("simpson")})


@_add("i9_cluster")
def i9(spark, d):
    return N.label_propagation(_knn(spark, d))


@_add("i11_transfer_labels", duck(f"with {_KNN}, v as (select a, label, round(sum(1 / (1 + distance)), 9) w from knn join m_emb on cell = b group by all) select cell, label, round(share, 6) share from (select a cell, label, w / sum(w) over (partition by a) share, row_number() over (partition by a order by w desc, label) k from v) where k = 1", "m_emb"))
def i11(spark, d):
    return N.transfer_labels(_knn(spark, d), view(spark, d, "m_emb")).withColumn("share", r("share"))


@_add("i11_score_sets", duck("with n as (select set_id, count(distinct feature) n from m_sets group by 1) select cell, set_id, round(sum(x) / any_value(n), 6) score from m_counts join (select distinct set_id, feature from m_sets) using (feature) join n using (set_id) group by 1, 2", "m_counts", "m_sets"))
def i11b(spark, d):
    return N.score_sets(view(spark, d, "m_counts"), view(spark, d, "m_sets")).withColumn("score", r("score"))


@_add("q17_doublet_score")
def q17(spark, d):
    return N.doublet_score(view(spark, d, "m_emb"))


@_add("i4_knn_descent")
def i4b(spark, d):
    return NB.knn_descent(view(spark, d, "m_emb"), K).withColumn("distance", r("distance"))


@_add("g2_metacell_counts", duck("select label metacell, feature, sum(x) x, count(*) cells from m_counts join m_emb using (cell) group by all", "m_counts", "m_emb"))
def g2b(spark, d):
    return N.metacell_counts(view(spark, d, "m_counts").select("cell", "feature", "x"), view(spark, d, "m_emb").selectExpr("cell", "label metacell"))


@_add("g2_metacells")
def g2(spark, d):
    return N.metacells(view(spark, d, "m_emb"), 25)


# Parts of even and of odd number over orders stand for elements and genes: every feature is on one side.
_SIDES = """c as (select * from m_counts), x as (select feature, cell, x from c where feature % 2 = 0), y as (select feature, cell, x from c where feature % 2 = 1),
n as (select count(distinct cell) n from c), pairs as (select distinct x.feature fx, y.feature fy from x join y using (cell)),
lc as (select fx, fy, round((n * sxy - sx * sy) / sqrt(nullif((n * sxx - sx * sx) * (n * syy - sy * sy), 0)), 6) + 0.0 corr from (
  select p.fx, p.fy, (select n from n)::double n, xs.s sx, xs.ss sxx, ys.s sy, ys.ss syy, xy.s sxy from pairs p
  join (select feature, sum(x) s, sum(x * x) ss from x group by 1) xs on xs.feature = fx join (select feature, sum(x) s, sum(x * x) ss from y group by 1) ys on ys.feature = fy
  join (select x.feature fx, y.feature fy, sum(x.x * y.x) s from x join y using (cell) group by 1, 2) xy on xy.fx = p.fx and xy.fy = p.fy))"""


def _sides(spark, d):
    c = materialize(view(spark, d, "m_counts").select("feature", "cell", "x"), "counts")
    return _split(c, "feature % 2 = 0", "feature % 2 = 1")


def _split(c, one, two):
    """Values of features on either side, their pairs that meet in a cell, and the number of cells."""
    size = c.count()
    x, y = c.where(one), c.where(two)
    fx, fy = x.select(F.col("feature").alias("fx"), "cell"), y.select(F.col("feature").alias("fy"), "cell")
    pairs = dealt(fx, size, "cell").join(dealt(fy, size, "cell"), "cell").select("fx", "fy").distinct()
    return x, y, pairs, dealt(c.select("cell"), size, "cell").agg(F.countDistinct("cell").alias("n"))


def _links(spark, d):
    return N.link_corr(*_sides(spark, d)).withColumn("corr", r("corr") + 0.0)


@_add("g3_link_corr", duck(f"with {_SIDES} select * from lc", "m_counts"))
def g3(spark, d):
    return _links(spark, d)


_GC = "round(coalesce((length(seq) - length(translate(seq, 'GC', ''))) / nullif(length(seq), 0), 0), 9)"


@_add(
    "g4_null_corr",
    duck(
        f"""with {_SIDES}, el as (select f.feature, f.mean, coalesce({_GC}, 0) gc from (select feature, sum(x) / (select n from n) mean from c group by 1) f left join m_seq on doc_id = f.feature),
sa as (select feature fx, ntile(5) over (order by mean, feature) || '-' || ntile(5) over (order by gc, feature) stratum from el),
rk as (select fx, fy, corr, stratum, row_number() over (partition by stratum order by md5(fx || ':' || fy), fx, fy) - 1 pos, count(*) over (partition by stratum) n from lc join sa using (fx) where corr is not null),
dr as (select fx, fy, corr, stratum, least(100, n - 1) m, unnest(list_transform(range(1, least(100, n - 1) + 1), lambda j: (pos + j) % n)) pos from rk),
hi as (select d.fx, d.fy, count(*) high from dr d join rk b on b.stratum = d.stratum and b.pos = d.pos where b.corr >= d.corr group by 1, 2)
select fx, fy, corr, round((1 + coalesce(high, 0)) / (1 + least(100, n - 1)), 9) p, least(100, n - 1)::bigint drawn from rk left join hi using (fx, fy)""",
        "m_counts",
        "m_seq",
    ),
)
def g4(spark, d):
    seq = view(spark, d, "m_seq").selectExpr("doc_id feature", f"{_GC} gc")
    stats = C.feature_moments(view(spark, d, "m_counts")).select("feature", "mean").join(seq, "feature", "left").withColumn("gc", F.coalesce("gc", F.lit(0.0)))
    return N.null_corr(materialize(_links(spark, d), "links"), stats, 100).withColumn("p", r("p", 9))


@_add("g5_bh_adjust", duck(f"with {_SIDES}, p as (select fx grp, fy id, 1 - abs(corr) p from lc where corr is not null), k as (select *, p * count(*) over (partition by grp) / row_number() over (partition by grp order by p, id) raw from p) select grp, id, round(p, 6) p, round(least(min(raw) over (partition by grp order by p desc, id desc rows unbounded preceding), 1), 6) q from k", "m_counts"))
def g5(spark, d):
    p = materialize(_links(spark, d), "links").where("corr is not null").select(F.col("fx").alias("grp"), F.col("fy").alias("id"), (1 - F.abs("corr")).alias("p"))
    return N.bh_adjust(p, "grp").withColumns({"p": r("p"), "q": r("q")})


_SUPP = "s_counts as (select l_suppkey feature, l_orderkey cell, sum(l_quantity) x from lineitem group by 1, 2)"


@_add("g6_tf_target_corr", duck(f"""with {_SUPP}, x as (select * from s_counts where feature % 10 = 0), y as (select * from s_counts where feature % 10 <> 0), n as (select count(distinct cell) n from s_counts),
xs as (select feature fx, sum(x) sx, sum(x * x) sxx from x group by 1), ys as (select feature fy, sum(x) sy, sum(x * x) syy from y group by 1), xy as (select x.feature fx, y.feature fy, sum(x.x * y.x) sxy from x join y using (cell) group by 1, 2)
select fx tf, fy gene, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) corr from xy join xs using (fx) join ys using (fy), n""", "m_cells"))
def g6(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    c = dealt(lines, lines.count(), "l_orderkey").groupBy(F.col("l_suppkey").alias("feature"), F.col("l_orderkey").alias("cell")).agg(F.sum("l_quantity").alias("x"))
    return N.link_corr(*_split(materialize(c, "counts"), "feature % 10 = 0", "feature % 10 <> 0")).select(F.col("fx").alias("tf"), F.col("fy").alias("gene"), r("corr").alias("corr"))


_GRN = f"""{_SIDES}, hits as (select distinct p_size tf, p_partkey pid from part where p_partkey % 2 = 0), links as (select fx pid, fy gene, corr from lc),
co as (select l_quantity::int % 50 + 1 tf, l_partkey gene, round(count(*) / 20.0, 6)::double corr from lineitem where l_partkey % 2 = 1 group by 1, 2),
tri as (select h.tf, h.pid, l.gene, l.corr link, c.corr coexp from hits h join links l using (pid) join co c on c.tf = h.tf and c.gene = l.gene where abs(l.corr) >= 0.02 and abs(c.corr) >= 0.02)"""


def _grn(spark, d):
    hits = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 2 = 0").selectExpr("p_size tf", "p_partkey pid")
    co = spark.read.parquet(f"{d}/lineitem.parquet").where("l_partkey % 2 = 1").groupBy(F.expr("cast(l_quantity as int) % 50 + 1").alias("tf"), F.col("l_partkey").alias("gene")).agg(F.round(F.count("*") / 20.0, 6).alias("corr"))
    return N.grn_edges(hits, _links(spark, d).select(F.col("fx").alias("pid"), F.col("fy").alias("gene"), "corr"), co, 0.02)


@_add("g7_grn_edges", duck(f"with {_GRN} select tf, gene, count(*) elements, max(abs(link)) link, min(coexp) coexp from tri group by all", "m_counts"))
def g7(spark, d):
    return _grn(spark, d)[1]


@_add("g8_grn_ridge")
def g8(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return N.grn_ridge(li.select(F.col("l_suppkey").alias("target"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("obs"), F.col("l_returnflag").alias("regulator"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")), 1.0)


@_add("g9_regulon_activity", duck("with k as (select *, row_number() over (partition by cell order by x desc, feature) k from m_counts) select cell, set_id, count(*) n, round(sum(6 - k) / 15, 6) activity from k join m_sets using (feature) where k <= 5 group by all", "m_counts", "m_sets"))
def g9(spark, d):
    return N.regulon_activity(view(spark, d, "m_counts"), view(spark, d, "m_sets"), 5).withColumn("activity", r("activity"))


_EDGES = "e as (select a src, b dst, 1 / (1 + distance) weight from knn)"


def _edges(spark, d):
    return _knn(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), (1 / (1 + F.col("distance"))).alias("weight"))


@_add("g10_network_degree", duck(f"with {_KNN}, {_EDGES}, u as (select src node, 1 o, 0 i from e union all select dst, 0, 1 from e) select node, sum(o)::bigint n_out, sum(i)::bigint n_in from u group by node order by sum(o) + sum(i) desc, node limit 20", "m_emb"))
def g10(spark, d):
    return N.network_degree(_edges(spark, d), 20)


@_add("g11_pagerank")
def g11(spark, d):
    return N.pagerank(_edges(spark, d)).withColumn("rank", r("rank", 9))


@_add("g12_network_diff", duck(f"""with {_KNN}, one as (select * from knn where rank <= 7), two as (select a, b, distance * (1 + (a + b) % 3 / 10.0::double) distance from knn where rank >= 4)
select src, dst, round(w1, 6) w1, round(w2, 6) w2, case when w1 is null then 'gained' when w2 is null then 'lost' when abs(w1 - w2) > 0.02 then 'changed' else 'same' end state
from (select coalesce(x.a, y.a) src, coalesce(x.b, y.b) dst, 1 / (1 + x.distance) w1, 1 / (1 + y.distance) w2 from one x full join two y on x.a = y.a and x.b = y.b)""", "m_emb"))
def g12(spark, d):
    e = _knn(spark, d)
    w = (1 / (1 + F.col("distance"))).alias("weight")
    ends = [F.col("a").alias("src"), F.col("b").alias("dst")]
    two = e.where("rank >= 4").withColumn("distance", F.col("distance") * (1 + (F.col("a") + F.col("b")) % 3 / 10.0))
    return N.network_diff(e.where("rank <= 7").select(*ends, w), two.select(*ends, w), 0.02).withColumns({"w1": r("w1"), "w2": r("w2")})


@_add("g13_network_components", duck(f"""with recursive {_KNN}, u as (select a, b from knn where rank = 1 union select b, a from knn where rank = 1), reach(node, other) as (select distinct a, a from u union select r.node, u.b from reach r join u on u.a = r.other)
select node, min(other) "label" from reach group by node""", "m_emb").replace("with m_emb", "with recursive m_emb").replace(", recursive d as", ", d as"))
def g13(spark, d):
    e = _knn(spark, d).where("rank = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return N.network_components(e)


