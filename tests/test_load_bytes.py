"""Bytes that the load, the CSV queries and the snapshots move: no finished row is shuffled."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from defectlens.operators import snapshot_rows as SR
from defectlens.plans.q_io import CSV_HEADERS, ENGLISH_HEADERS
from defectlens.session import scratch_path
from defectlens.sources import adapter as A
from defectlens.sources import csv_source as CS
from defectlens.sources import header_map as HM

TABLES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz",
                 [(o, o % 40, o % 21 if o % 5 else None, n, float(o), "RAN"[o % 3], "FO"[n % 2], None) for o in range(60) for n in (1, 2)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string",
               [(o, o % 5, "OFP"[o % 3], None, "2-HIGH") for o in range(50)]),
    "part": ("p_partkey long, p_name string, p_type string, p_brand string",
             [(p, None if p == 4 else f"Red ring {p}", None if p == 5 else "LARGE", "B") for p in range(38)]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(c, c, "S") for c in range(5)]),
    "nation": ("n_nationkey int, n_regionkey int", [(n, n) for n in range(5)]),
    "region": ("r_regionkey int, r_name string", [(0, "EUROPE"), (1, "ASIA"), (2, None), (3, "AMERICA"), (4, "AFRICA")]),
    "supplier": ("s_suppkey long, s_name string", [(k, None if k in (1, 2) else f"S{k}") for k in range(15)]),
}


@pytest.fixture(scope="module")
def star(spark):
    root = scratch_path(spark, "star")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_load_sends_source_columns_only(spark, star):
    """the finished rows stay in the tasks of the star join."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.load_rows(spark, star)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "REBALANCE" not in plan
    # derived columns (tags, lower-cased labels) are projected above the last exchange and sort
    assert plan.index("status_lc") < plan.index("Sort [sprint_num") < plan.index("Exchange")
    assert "status_lc" not in plan[plan.index("Sort [sprint_num"):] and "AS tags" not in plan[plan.index("Sort [sprint_num"):]


def test_load_keeps_rows_and_rules(spark, star):
    path = A.materialize_issues(spark, star, scratch_path(spark, "issue-star"))
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 * len([o for o in range(50) if o % 40 < 38])
    by = {(r.issue_id // 10): r for r in rows}
    # supplier 1 has no name, but its rule gives ''; 2 has none; 10 none by rule; 16 is unmatched
    assert [by[o].assignee for o in (1, 2, 3, 31, 37)] == ["", None, "S3", None, None]
    assert by[4].tags == [] and by[4].summary is None and by[6].tags == ["red", "ring", "6"]
    assert by[5].module is None and by[13].priority == "Major" and by[0].sprint is None


def test_cells_are_neither_sorted_nor_shuffled(spark):
    """with two header layouts, the cells meet their headers by broadcast."""
    path, landed = scratch_path(spark, "csv-plan"), scratch_path(spark, "cells-plan")
    names = sorted(set(CSV_HEADERS) | set(ENGLISH_HEADERS))
    df = spark.range(40).select(*[F.concat(F.lit(f"{c} "), F.col("id")).alias(c) for c in names])
    CS.write_issue_csv(df.filter("id < 20"), path, CSV_HEADERS)
    CS.write_issue_csv(df.filter("id >= 20"), path, ENGLISH_HEADERS, mode="append")
    assert glob.glob(os.path.join(path, "*.csv.gz")) and not glob.glob(os.path.join(path, "*.csv"))
    HM.in_file_order(HM.read_cells(spark, path)).write.parquet(landed)
    rows = spark.read.parquet(landed)
    iss = HM.issues_of(rows, HM.file_headers(rows))
    assert "BroadcastHashJoin" in plan_of(iss) and "SortMergeJoin" not in plan_of(iss) and "SortAggregate" not in plan_of(iss)
    assert sorted(r.status for r in iss.select("status").collect()) == sorted(f"status {i}" for i in range(40))
    assert {r.priority for r in iss.filter("sprint = 'sprint 33'").collect()} == {"priority 33"}


def test_csv_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(CS, "CSV_ROWS", 10)
    path = scratch_path(spark, "csv-parts")
    CS.write_issue_csv(spark.range(0, 35, 1, 1).selectExpr("concat('Sprint ', id) AS sprint"), path, {"sprint": "Sprint"})
    assert len(glob.glob(os.path.join(path, "*.csv.gz"))) == 4
    rows = HM.in_file_order(HM.read_cells(spark, path))
    assert HM.issues_of(rows, HM.file_headers(rows)).select("sprint_num").distinct().count() == 35


def test_once_per_key(spark):
    """least values of repeated (and null) keys, other rows as they are, dealt to their buckets once."""
    rows = [(1, 3, "b", None), (1, 2, "a", "z"), (2, 5, None, None), (None, 7, "q", "r"), (None, 6, "s", None), (4, 8, "t", "u")]
    path = scratch_path(spark, "once")
    once = SR.once_per_key(spark.createDataFrame(rows, "k long, g int, a string, b string"), "k", path, SR.bucket_of("g"))
    assert sorted((tuple(r) for r in once.select("k", "g", "a", "b").collect()), key=str) == sorted(
        [(1, 2, "a", "z"), (2, 5, None, None), (None, 6, "q", "r"), (4, 8, "t", "u")], key=str)
    root = scratch_path(spark, "once-versions")
    SR.write_snapshot(once, root, "1", SR.bucket_of("g"), dealt=True)
    SR.write_snapshot(once.withColumn("a", F.when(F.col("k") == 4, "T").otherwise(F.col("a"))), root, "2", SR.bucket_of("g"), dealt=True)
    assert [(r.k, r.change) for r in SR.row_diff(spark, root, "1", "2", ["k"]).collect()] == [(4, "changed")]
