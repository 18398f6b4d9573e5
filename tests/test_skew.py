"""A hot key holding a third of all rows: results equal a pandas brute force,
and the aggregation is partial before the shuffle (no raw rows move)."""

import math

from pyspark.sql import functions as F

from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import trends as TR
from defectlens.operators.sprints import sprint_frame
from defectlens import config as C
from defectlens.sources.adapter import Tables
from tests.conftest import SF_SMALL


def _skewed(spark):
    iss = Tables(spark, SF_SMALL).issues
    hot = (F.abs(F.hash("issue_id")) % 3) == 0          # about a third of the rows
    return iss.withColumn("assignee", F.when(hot, F.lit(None)).otherwise(F.col("assignee"))) \
              .withColumn("module", F.when(hot, F.lit("HOT")).otherwise(F.col("module")))


def js_round(x):
    return math.floor(x + 0.5)


def test_hot_key_matches_brute_force(spark):
    df = _skewed(spark)
    pdf = df.select("issue_id", "sprint", "sprint_num", "status", "issue_type", "assignee", "module").toPandas()
    assert 0.25 < (pdf.module == "HOT").mean() < 0.42

    # Per assignee (NULL group kept), bugs only
    bugs = pdf[pdf.issue_type.str.lower() == "bug"]
    closed = bugs.status.isin(["Done", "Resolved", "Closed"])
    exp = bugs.assign(res=closed.astype(int), pend=(~closed & bugs.status.notna()).astype(int)).groupby(  # a NULL status is neither
        bugs.assignee.fillna("<null>")).agg(total=("issue_id", "size"), resolved=("res", "sum"), pending=("pend", "sum"))
    got = R.assignee_summary(df).toPandas()
    got.index = got.assignee.fillna("<null>")
    got = got.sort_index()[["total", "resolved", "pending"]]
    assert got.to_dict() == exp.sort_index()[["total", "resolved", "pending"]].astype("int64").to_dict()

    # Module shares with the hot module
    cnt = pdf.groupby(pdf.module.fillna("").str.strip().replace("", C.DEFAULT_MODULE_LABEL)).size()
    exp13 = {m: js_round(c / cnt.sum() * 100) for m, c in cnt.items()}
    got13 = {r.module: r.percentage for r in R.module_breakdown(df).collect()}
    assert got13 == exp13

    # K2 / K16 per module and W6 for the hot module
    sp = sprint_frame(df, ["module"])
    k = {r.module: r for r in K.kpis(sp, ["module"]).collect()}
    for m, g in pdf.groupby("module"):
        done = (g.status == "Done").sum()
        assert k[m].resolution_efficiency == (js_round(done / len(g) * 100) if len(g) else 0)
        per = g.groupby("sprint_num").size()
        assert k[m].avg_bugs_per_sprint == js_round(per.sum() / len(per))
    hot = pdf[pdf.module == "HOT"]
    vel = hot[hot.status == "Done"].groupby("sprint_num").size().reindex(
        sorted(hot.sprint_num.unique()), fill_value=0)
    prev = vel.shift(1).fillna(vel)
    exp6 = [0 if p <= 0 else js_round((v - p) / p * 100) for v, p in zip(vel.values, prev.values)]
    got6 = [r.change for r in TR.velocity_change(sp.filter(F.col("module") == "HOT"), ["module"])
            .orderBy("sprint_num").collect()]
    assert got6 == exp6


def test_partial_aggregation_before_shuffle(spark):
    plan = R.assignee_summary(_skewed(spark))._jdf.queryExecution().executedPlan().toString()
    # partial HashAggregate below the exchange: each task ships one row per key it saw
    assert "HashAggregate" in plan and "Exchange" in plan and "partial_" in plan
