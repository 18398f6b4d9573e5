"""The sprint roll-up: one row per (group, sprint) with every counter the
KPIs, trends and rules need, computed in ONE aggregation pass over issues.

Everything downstream (KPIs, series, comparisons, alerts) runs on this
roll-up, whose size is groups x sprints (thousands of rows for thousands of
projects), never on the issue table again.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators.rollups import keys

SPRINT_COLUMNS = [
    "sprint", "sprint_num", "bugs", "bugs_resolved", "bugs_pending", "test_cases", "test_planned",
    "velocity", "planned_velocity", "critical_total", "critical_pending", "production_bugs",
    "tc_passed", "crit_all", "crit_pending_view", "reopened", "c_mas_alta", "c_alta", "res_days_sum", "res_days_n",
]


@lru_cache(maxsize=64)
def _sprint_exprs(cfg_key: str, done_status: str):
    """Aggregate and projection expressions of the roll-up (unresolved
    Columns depend only on the config, so they are built once)."""
    cfg = C.Config.from_key(cfg_key)
    crit = F.col("priority").isin(cfg.critical_labels)
    done = F.col("status") == done_status
    days = F.datediff(F.col("resolved_at"), F.col("created_at"))
    pos = days > 0
    aggs = [
        F.count(F.lit(1)).alias("bugs"),
        F.count_if(done).alias("bugs_resolved"),
        F.sum("cases_executed").cast("long").alias("test_cases"),
        F.sum("cases_planned").cast("long").alias("test_planned"),
        F.count_if(crit).alias("critical_total"),
        F.count_if(crit & ~done).alias("critical_pending"),
        F.count_if(F.col("environment") == "PROD").alias("production_bugs"),
        F.coalesce(F.sum(F.when(done, F.col("cases_executed"))), F.lit(0)).cast("long").alias("tc_passed"),
        F.count_if(F.col("priority").isin(C.CRITICAL_LABELS_ALL)).alias("crit_all"),
        F.count_if(crit & F.col("status").isin(C.PENDING_STATUS_PRIORITY_VIEW)).alias("crit_pending_view"),
        F.count_if(F.col("status").isin(C.REOPENED_STATUS)).alias("reopened"),
        F.count_if(F.col("priority") == "Más alta").alias("c_mas_alta"),
        F.count_if(F.col("priority") == "Alta").alias("c_alta"),
        F.coalesce(F.sum(F.when(pos, days)), F.lit(0)).cast("long").alias("res_days_sum"),
        F.count_if(pos).alias("res_days_n"),
    ]
    proj = [
        "bugs", "bugs_resolved", (F.col("bugs") - F.col("bugs_resolved")).alias("bugs_pending"),
        "test_cases", "test_planned", F.col("bugs_resolved").alias("velocity"),
        F.col("bugs").alias("planned_velocity"),
        "critical_total", "critical_pending", "production_bugs", "tc_passed",
        "crit_all", "crit_pending_view", "reopened", "c_mas_alta", "c_alta", "res_days_sum", "res_days_n",
    ]
    return aggs, proj


def sprint_frame(issues: DataFrame, by=None, cfg: C.Config | None = None,
                 done_status: str = "Done") -> DataFrame:
    """Sprint roll-up (FIXTURES.md): bugs, resolved (``Done``), pending,
    executed / planned cases, velocity = resolved, planned velocity = bugs,
    critical = configured critical labels, critical pending = critical and
    not done.  Extra counters for the KPI record ride in the same pass:
    ``crit_all`` (the five critical labels of K6), ``crit_pending_view``
    (critical in the To Do / In Development sense of the priority view, K8),
    reopened issues (K33) and positive report-to-resolution days (K9/K37).
    """
    cfg = cfg or C.Config()
    aggs, proj = _sprint_exprs(cfg.key(), done_status)
    agg = issues.groupBy(*keys(by), "sprint", "sprint_num").agg(*aggs)
    return agg.select(*keys(by), "sprint", "sprint_num", *proj)


def summary_frame(sprints: DataFrame, by=None) -> DataFrame:
    """Summary record per group: totals of the sprint roll-up."""
    s = lambda c: F.sum(c).cast("long")
    return sprints.groupBy(*keys(by)).agg(
        s("bugs").alias("total_bugs"),
        s("bugs_resolved").alias("bugs_closed"),
        s("bugs_pending").alias("bugs_pending"),
        s("test_planned").alias("tc_total"),
        s("test_cases").alias("tc_executed"),
        s("tc_passed").alias("tc_passed"),
        (s("test_cases") - s("tc_passed")).alias("tc_failed"),
        s("production_bugs").alias("production_bugs"),
        s("reopened").alias("rework_bugs"),
        F.count(F.lit(1)).alias("n_sprints"),
    )
