"""Tables dealt by rows: tasks of bounded size, the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellweft.operators import running, tables
from cellweft.plans.registry import QUERIES, SQL
from tests.oracle import assert_same


def test_partitions_grow_with_the_rows_and_are_not_merged(spark):
    df = spark.range(4000).selectExpr("id % 1000 k", "id v")
    assert tables.dealt(df, 4000, "k").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    sums = tables.dealt(df, 4000, "k", most=100).groupBy("k").sum("v")
    assert sums.rdd.getNumPartitions() == 40
    assert sums.count() == 1000


@pytest.mark.parametrize("name", ["i11_score_sets", "g9_regulon_activity"])
def test_counts_stay_dealt_by_cell(spark, duck, sf_dir, monkeypatch, name):
    """What is grouped by cell after the counts is as many tasks as the counts are; four shuffle partitions before."""
    monkeypatch.setattr(tables, "MOST", 200, raising=False)
    out = QUERIES[name](spark, sf_dir)
    most = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert out.rdd.getNumPartitions() == -(-most // 200)
    assert_same(out, duck.sql(SQL[name]))


@pytest.mark.parametrize("name", ["g3_link_corr", "g6_tf_target_corr"])
def test_links_are_dealt_by_pairs(spark, duck, sf_dir, monkeypatch, name):
    """The joins at the pairs are as many tasks as the pairs need; four shuffle partitions before."""
    monkeypatch.setattr(tables, "MOST", 200, raising=False)
    out = QUERIES[name](spark, sf_dir)
    size = out.count()
    if size > 200 * spark.sparkContext.defaultParallelism:
        assert out.rdd.getNumPartitions() == -(-size // 200)
    assert size > 4000 or name != "g3_link_corr"
    assert_same(out, duck.sql(SQL[name]))


def test_running_values_are_dealt_by_rows(spark, monkeypatch):
    """With their number known, rows are dealt before and after they are written."""
    monkeypatch.setattr(tables, "MOST", 100, raising=False)
    df = spark.range(4000).selectExpr("id % 3 g", "id i", "id % 7 v")
    out = running.running(df, ["g"], ["i"], "v", "low", F.max, own=True, size=4000)
    assert out.rdd.getNumPartitions() == 40
    got = {(r.g, r.i): r.low for r in running.running_totals(df, ["g"], ["i"], "v", "low", 4000).collect()}
    assert got == {(i % 3, i): sum(j % 7 for j in range(i % 3, i, 3)) for i in range(4000)}


@pytest.mark.parametrize("name", ["g4_null_corr", "g5_bh_adjust", "g7_grn_edges"])
def test_what_follows_links_is_the_same(spark, duck, sf_dir, monkeypatch, name):
    monkeypatch.setattr(tables, "MOST", 200, raising=False)
    assert_same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))
