"""Source merging and small helpers."""

import datetime as dt

from pyspark.sql import functions as F

from defectlens.operators.rollups import top2_priority_sum
from defectlens.sources import merge as M


def test_fallback_and_priority(spark):
    a = spark.createDataFrame([("s1", 1)], "sprint string, total long")
    b = spark.createDataFrame([("s1", 9), ("s2", 2)], "sprint string, total long")
    assert sorted(tuple(r) for r in M.fallback(a, b, ["sprint"]).collect()) == [("s1", 1), ("s2", 2)]
    u = M.union_by_priority([("json", a), ("db", b)], ["sprint"])
    assert sorted((r.sprint, r.total, r.source) for r in u.collect()) == [("s1", 1, "json"), ("s2", 2, "db")]


def test_default_if_empty(spark):
    empty = spark.createDataFrame([], "total_bugs long")
    dflt = spark.createDataFrame([(0,)], "total_bugs long")
    assert M.default_if_empty(empty, dflt).count() == 1
    one = spark.createDataFrame([(5,)], "total_bugs long")
    assert [r.total_bugs for r in M.default_if_empty(one, dflt).collect()] == [5]


def test_view_rows_and_pick(spark):
    rows = spark.createDataFrame([("Sprint A", "7", 1), (None, "x", 2)], "sprint string, sprint_num string, o int")
    out = {r.o: (r.sprint, r.sprint_num) for r in M.view_sprint_rows(rows, order_col="o").collect()}
    assert out == {1: ("Sprint A", 7), 2: ("Sprint 2", 2)}
    assert M.pick_fields(rows, ["o", "nope", "sprint"]).columns == ["o", "sprint"]


def test_module_rows_and_test_type(spark):
    docs = spark.createDataFrame([("d", {"POS": {"count": 5, "pending": 0}})],
                                 "doc_path string, bugsByModule map<string, struct<count: long, pending: long>>")
    r = M.module_rows(docs).collect()[0]
    assert (r.module, r.total, r.pending) == ("POS", 5, 0)
    sp = spark.createDataFrame([("S1", "uat"), ("S2", "system")], "sprint string, test_type string")
    lab = spark.createDataFrame([("S1",), ("S2",)], "sprint string")
    assert [r.sprint for r in M.sprints_for_test_type(sp, lab, "uat").collect()] == ["S1"]


def test_small_helpers(spark):
    df = spark.createDataFrame([({"a": 3, "b": 9, "c": 1}, '{"k": 42}', dt.datetime(2025, 2, 3, 4, 5))],
                               "m map<string, long>, props string, ts timestamp_ntz")
    r = df.select(top2_priority_sum(F.col("m")).alias("t"), M.json_field(F.col("props"), "k").alias("k"),
                  M.display_date(F.col("ts")).alias("d"), M.safe_number(F.lit("x1")).alias("s")).first()
    assert (r.t, r.k, r.d, r.s) == (12, 42.0, "02/03/2025 04:05", 0.0)
