"""Invariants on the driver tables (sf0.001) and on literal series."""

from pyspark.sql import functions as F

from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import trends as TR
from defectlens.operators.sprints import sprint_frame
from defectlens.sources.adapter import Tables
from tests.conftest import SF_SMALL


def test_resolved_plus_pending(spark):
    sp = sprint_frame(Tables(spark, SF_SMALL).issues, ["module"])
    assert sp.filter(F.col("bugs_resolved") + F.col("bugs_pending") != F.col("bugs")).count() == 0
    pb = R.priority_breakdown(Tables(spark, SF_SMALL).issues, ["module"])
    assert pb.filter(F.col("resolved") + F.col("pending") != F.col("count")).count() == 0


def test_shares_and_index_bounds(spark):
    iss = Tables(spark, SF_SMALL).issues
    tot = R.module_breakdown(iss).agg(F.sum("percentage")).collect()[0][0]
    assert abs(tot - 100) <= 6                         # rounding of six shares
    k = K.kpis(sprint_frame(iss, ["environment"]), ["environment"]).collect()
    assert all(0 <= r.quality_index <= 100 for r in k)
    assert all(r.maturity_score is None or 0 <= r.maturity_score <= 5 for r in k)


def _series(spark, values):
    rows = [("g", f"Sprint {i}", i + 1, v, v // 2, v - v // 2, v * 2, v * 3, v // 2, v, 0, 0)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, sprint string, sprint_num int, bugs long, bugs_resolved long, "
                                       "bugs_pending long, test_cases long, test_planned long, velocity long, "
                                       "planned_velocity long, critical_total long, critical_pending long")


def test_constant_series_half_split_is_zero(spark):
    h = TR.half_split_trends(_series(spark, [10, 10, 10, 10]), ["g"]).collect()[0]
    assert (h.test_cases_trend, h.resolution_trend, h.critical_bugs_trend, h.execution_trend) == (0, 0, 0, 0)


def test_short_series(spark):
    one = _series(spark, [5])
    assert TR.velocity_change(one, ["g"]).count() == 0                      # < 2 sprints -> no rows
    fl = TR.first_last_change(one, ["g"]).collect()[0]
    assert fl.trend == 0 and fl.series_change is None
    assert TR.sprint_comparison(one, ["g"]).count() == 0
    three = _series(spark, [0, 4, 8])
    fl3 = TR.first_last_change(three, ["g"]).collect()[0]
    assert fl3.trend == 0 and fl3.series_change == 800                    # first 0: W1 0, W16 uses |first| || 1
    v = [r.change for r in TR.velocity_change(three, ["g"]).orderBy("sprint_num").collect()]
    assert v == [0, 0, 100]


def test_bulk_load_roundtrip(spark):
    """The partitioned issue table reads back equal to the lazy star join."""
    from defectlens.session import scratch_path
    from defectlens.sources.adapter import materialize_issues
    path = materialize_issues(spark, SF_SMALL, scratch_path(spark, "issue-test"))
    back = Tables(spark, SF_SMALL, issue_path=path).issues
    lazy = Tables(spark, SF_SMALL).issues
    assert back.count() == lazy.count()
    a = sorted(tuple(r) for r in R.issues_by_sprint(back).collect())
    b = sorted(tuple(r) for r in R.issues_by_sprint(lazy).collect())
    assert a == b
    assert back.filter(F.col("status_lc") == "done").count() == lazy.filter(F.col("status") == "Done").count()
