"""Stand-in inputs over the given tables, in Spark and in SQL.

They have the shapes that the operators need (counts, fragments, intervals,
embeddings, sequences, alignments), not biological content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.operators.tables import dealt

_CHROM = "case {k} when 0 then 'click' when 1 then 'view' when 2 then 'error' when 3 then 'purchase' else 'signup' end"
_SEC_SPARK = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
_SEC_DUCK = "floor(epoch(ts)-epoch(timestamp '2024-01-01'))::bigint"


def chrom(k: str) -> str:
    return _CHROM.format(k=k)


#: view: (tables, Spark SQL, DuckDB SQL); one text where both engines read it alike.
VIEWS: dict[str, tuple[list[str], str, str]] = {}


def _view(name: str, tables: str, spark_sql: str, duck_sql: str | None = None) -> None:
    VIEWS[name] = (tables.split(), spark_sql, duck_sql or spark_sql)


_view("m_counts", "lineitem orders", "select o_orderpriority sample, l_orderkey cell, l_partkey feature, sum(l_quantity) x from lineitem join orders on l_orderkey=o_orderkey group by 1,2,3")
_view("m_cells", "orders lineitem", "select o_orderkey cell, o_orderpriority sample, o_custkey%4 stage, o_orderstatus cell_type from orders where o_orderkey in (select l_orderkey from lineitem)")
_view(
    "m_frag",
    "events",
    f"select event_id fid, user_id cell, event_type chrom, {_SEC_SPARK} st, {_SEC_SPARK}+50+cast(floor(value) as bigint) en from events",
    f"select event_id fid, user_id cell, event_type chrom, {_SEC_DUCK} st, {_SEC_DUCK}+50+floor(value)::bigint en from events",
)
_view("m_peaks", "orders", f"select o_orderkey pid, {chrom('o_custkey%5')} chrom, (o_orderkey*173)%2592000 st, (o_orderkey*173)%2592000+200+o_custkey%2000 en from orders")
_view("m_tss", "part", f"select p_partkey gene, {chrom('p_partkey%5')} chrom, (p_partkey*1297)%2592000 tss, case when p_size%2=0 then '+' else '-' end strand from part")
_view(
    "m_track",
    "customer",
    f"select {chrom('c_custkey%5')} chrom, (c_custkey div 5)*1728 st, (c_custkey div 5)*1728+1728 en, c_acctbal score from customer",
    f"select {chrom('c_custkey%5')} chrom, (c_custkey//5)*1728 st, (c_custkey//5)*1728+1728 en, c_acctbal score from customer",
)
_view("m_emb", "embeddings", "select vec_id cell, vec_id%4 sample, label, embedding vec from embeddings")
_view(
    "m_trend",
    "events",
    f"select event_type feature, cast({_SEC_SPARK} div 86400 as int) bin, avg(value) y from events group by 1,2",
    "select event_type feature, cast(floor((epoch(ts)-epoch(timestamp '2024-01-01'))/86400) as int) bin, avg(value) y from events group by 1,2",
)
_view(
    "m_seq",
    "documents",
    "select doc_id, translate(regexp_replace(lower(text),'[^acgt]',''),'acgt','ACGT') seq from documents",
    "select doc_id, translate(regexp_replace(lower(text),'[^acgt]','','g'),'acgt','ACGT') seq from documents",
)
_view("m_sets", "part", "select p_type set_id, p_partkey feature from part")
_view(
    "m_blocks",
    "nation",
    f"select {chrom('n_nationkey%5')} src_chrom, (n_nationkey div 5)*100000 src_start, (n_nationkey div 5)*100000+80000 src_end, concat('d',n_nationkey%5) dst_chrom, (n_nationkey div 5)*110000+5000 dst_start, (n_nationkey div 5)*110000+85000 dst_end, case when n_nationkey%2=0 then '+' else '-' end dst_strand, n_nationkey chain from nation",
    f"select {chrom('n_nationkey%5')} src_chrom, (n_nationkey//5)*100000 src_start, (n_nationkey//5)*100000+80000 src_end, concat('d',n_nationkey%5) dst_chrom, (n_nationkey//5)*110000+5000 dst_start, (n_nationkey//5)*110000+85000 dst_end, case when n_nationkey%2=0 then '+' else '-' end dst_strand, n_nationkey chain from nation",
)
_view(
    "m_rows",
    "documents",
    "select doc_id div 2 block, cast(doc_id%2 as string) species, seq text from m_seq",
    "select doc_id//2 block, (doc_id%2)::varchar species, seq text from m_seq",
)

_NEEDS = {"m_rows": ["m_seq"]}
#: Keys by which the tables of a view are dealt, so that its join, its groups and what follows by cell are tasks of bounded size.
_KEYS = {"m_counts": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql, _ = VIEWS[name]
    made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name in _KEYS:
        most = max(df.count() for df in made.values())  # from the files' footers
        made = {t: dealt(df, most, _KEYS[name][t]) for t, df in made.items()}
    made |= {v: view(spark, sf_dir, v) for v in _NEEDS.get(name, [])}
    for k in made:  # named arguments keep the catalog free of temporary views
        sql = sql.replace(f" {k} ", f" {{{k}}} ").replace(f" {k})", f" {{{k}}})") if f" {k}" in sql else sql
        if sql.endswith(f" {k}"):
            sql = sql[: -len(k)] + f"{{{k}}}"
    made = {k: v for k, v in made.items() if f"{{{k}}}" in sql}
    return spark.sql(sql, **made)


def duck(body: str, *names: str) -> str:
    """`body` with the SQL of the views that it uses in front."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*_NEEDS.get(n, []), n) if x not in wanted]
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][2]})" for n in wanted) + "\n" + (", " + body[5:] if body.startswith("with ") else body)


def literal_pwm(spark: SparkSession) -> DataFrame:
    """Two motifs as weights per position and base."""
    rows = [(m, i, b, w) for m, cols in PWM.items() for i, col in enumerate(cols) for b, w in zip("ACGT", col, strict=True)]
    return spark.createDataFrame(rows, "motif string, pos int, base string, w double")


#: Motif weights for the queries: positions of (A, C, G, T).
PWM = {
    "catt": [(-1.0, 1.25, -2.0, -0.5), (1.5, -1.0, -1.0, -0.75), (-1.0, -0.5, -1.5, 1.25), (-0.25, -1.0, -0.5, 1.0)],
    "gaca": [(-0.5, -1.0, 1.5, -1.0), (1.25, -0.5, -0.75, -1.0), (-1.0, 1.5, -0.5, -0.25), (1.0, -1.0, -0.5, -0.5)],
}


def duck_pwm() -> str:
    rows = ", ".join(f"('{m}', {i}, '{b}', {w}::double)" for m, cols in PWM.items() for i, col in enumerate(cols) for b, w in zip("ACGT", col, strict=True))
    return f"pwm(motif, pos, base, w) as (values {rows})"


def r(col, digits: int = 6):
    """A double rounded for comparison."""
    return F.round(col, digits)
