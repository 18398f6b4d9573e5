"""Rules as a table equal the compiled rules; bitmap counts equal count(DISTINCT); view rows are numbered."""

import random

import pytest
from pyspark.sql import functions as F

from defectlens.operators import distinct_counts as DC
from defectlens.operators import rule_intervals as RI
from defectlens.operators import rules as RU
from defectlens.operators.rule_table import DEFAULT_RULES
from defectlens.sources.merge import view_sprint_rows

METRICS = "g string, metric string, avg double, efficiency double, total double, pending double, byPriority__critical double, critical double"
EXTRA = [("cycleTime", "avg > 1 && avg > 5 && avg <= 9 && byPriority.critical >= 2", "Two fields: both", "alta"),
         ("cycleTime", "avg > 5 && avg < 5", "empty interval", "alta"), ("cycleTime", "avg === 5", "a point", None),
         ("cycleTime", "alert(1)", "no rule", "alta"), ("cycleTime", "unknown > 1", "no field", "alta"), ("cycleTime", "", "blank", "alta"),
         ("cycleTime", "avg > 1 &&", "cut off", "alta"), ("cycleTime", " default ", "always", "urgent")]


def metric_rows():
    rng = random.Random(2)
    rows = []
    for g in ("a", "b", None):
        for m in ("testCases", "resolutionEfficiency", "criticalBugs", "criticalBugsStatus", "cycleTime", "defectDensity"):
            values = [rng.choice([None, 0.0, 0.3, 0.5, 1.0, 2.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0, 70.0, 80.0, 150.0, 200.0]) for _ in range(6)]
            rows.append((g, m, *values))
    return rows


@pytest.mark.parametrize("rules", [DEFAULT_RULES, DEFAULT_RULES + EXTRA])
def test_intervals_equal_compiled_rules(spark, rules):
    metrics = spark.createDataFrame(metric_rows(), METRICS)
    want = RU.evaluate_rules(metrics, rules, ["g"])
    got = RI.evaluate_rule_table(metrics, RU.rules_frame(spark, rules), ["g"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ten_thousand_user_rules(spark):
    metrics = spark.createDataFrame(metric_rows(), METRICS)
    user = spark.range(10_000).select(F.lit("tiempoPromedioResolucion").alias("metric"), F.concat(F.lit("avg >= "), (F.col("id") / 100).cast("string")).alias("condition"),
                                      F.lit("x").alias("text"), F.lit("baja").alias("priority"))
    rules = RU.effective_rules(RU.rules_frame(spark), RI.numbered_rules(user, len(DEFAULT_RULES)))
    got = {(r.g): r.n for r in RI.evaluate_rule_table(metrics, rules, ["g"]).filter("metric = 'cycleTime'").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r[0]: sum(k / 100 <= r[2] for k in range(10_000)) for r in metric_rows() if r[1] == "cycleTime" and r[2] is not None}
    assert got == {g: n for g, n in want.items() if n}


def test_bitmap_counts_equal_distinct(spark):
    rng = random.Random(7)
    names = [None, "", *(f"u{i}" for i in range(50_000))]
    rows = [(rng.choice(["x", "y", None]), rng.randrange(3), rng.choice(names)) for _ in range(100_000)]
    df = spark.createDataFrame(rows, "g string, k int, who string")
    rollup = DC.bitmap_rollup(df, ["g", "k"], "who", DC.dictionary(df, "who"))
    for by in (["g"], ["k"], ["g", "k"], []):
        got = {tuple(r)[:len(by)]: (r.n, r.rows) for r in DC.distinct_counts(rollup, by, "n").collect()}
        want = df.groupBy(*by).agg(F.count_distinct(F.nullif("who", F.lit(""))).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        assert got == {tuple(r)[:len(by)]: (r.n, r.rows) for r in want}
    assert rollup.filter("range > 1").count() > 0  # more ids than one bitmap holds


def test_view_rows_numbered_in_order_with_ties(spark):
    view = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1), (None, 9)], "sprint_name string, day int").repartition(3)
    got = view_sprint_rows(view, order_col=["day", "sprint_name"]).orderBy("sprint_num").collect()
    assert [(r.sprint_num, r.sprint) for r in got] == [(1, "c"), (2, "a"), (3, "b"), (4, "Sprint 4")]
    assert view_sprint_rows(view.filter("day > 99"), order_col="day").count() == 0
