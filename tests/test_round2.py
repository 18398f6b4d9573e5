"""Order, precedence, null keys and missing versions."""

import pytest
from pyspark.sql import functions as F

from defectlens.operators import rollups as R
from defectlens.operators import rules as RU
from defectlens.operators.topk import developers_by_pending
from defectlens.plans import report as RP
from defectlens.session import scratch_path
from defectlens.sources import versions as VS
from defectlens.sources.adapter import Tables
from tests.conftest import SF_SMALL


def test_alert_ties_keep_rule_order(spark):
    kpi = spark.createDataFrame([(99, 10, 5)], "critical_pending int, test_execution_rate int, sprint_trend int")
    devs = spark.createDataFrame([("Ann", 50)], "assignee string, pending int")
    mods = spark.createDataFrame([("POS", 80)], "module string, percentage int")
    rows = RU.alerts(kpi, devs, mods).orderBy("rank").collect()
    assert [r.alert_id for r in rows][:4] == ["critical-bugs-high", "developer-overload", "module-critical-POS", "low-test-coverage"]
    assert [r.shown for r in rows][:4] == [True, True, True, False]


def test_user_rules_of_the_new_name_come_first(spark):
    old, new = next(iter(RU.METRIC_NAME_MAP.items()))
    schema = "rule_id int, metric string, condition string, text string, priority string"
    defaults = spark.createDataFrame([(0, old, "value > 1", "default", "alta"), (1, "other", "value > 1", "kept", "alta")], schema)
    user = spark.createDataFrame([(0, old, "value > 1", "by old name", "alta"), (1, new, "value > 1", "by new name", "alta")], schema)
    assert {r.text for r in RU.effective_rules(defaults, user).collect()} == {"kept", "by new name"}
    assert {r.text for r in RU.effective_rules(defaults, user.filter(F.col("metric") == old)).collect()} == {"kept", "by old name"}


def test_null_group_keeps_its_share(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v long")
    assert {r.k: r.t for r in R.with_group_total(df, "v", ["k"], "t").collect()} == {"a": 1, None: 2}


def test_rollup_document_without_keys(spark):
    doc = RP.rollup_document(Tables(spark, SF_SMALL).issues).first()
    assert doc.bugsByPriority and doc.bugsByModule and doc.bugsByCategory and doc.developerData


def test_all_developers_are_returned(spark):
    issues = Tables(spark, SF_SMALL).issues
    n = issues.filter("assignee IS NOT NULL AND assignee <> ''").select("assignee").distinct().count()
    rows = developers_by_pending(issues).collect()
    assert len(rows) == n and [r.pending for r in rows] == sorted((r.pending for r in rows), reverse=True)


def test_unknown_version_changes_nothing(spark):
    root, current = scratch_path(spark, "versions"), scratch_path(spark, "current")
    df = spark.createDataFrame([(1,), (2,)], "issue_id int")
    df.write.parquet(current)
    VS.write_snapshot(df.limit(1), root, "001")
    with pytest.raises(ValueError):
        VS.switch_version(spark, root, current, "nope")
    assert spark.read.parquet(current).count() == 2
    assert VS.read_version(spark, root, "001").count() == 1


def test_csv_files_of_two_column_orders(spark, tmp_path):
    from defectlens.sources import csv_source as CS
    (tmp_path / "a.csv").write_text('Sprint,Estado,Resumen\nSprint 1,Done,"x, ""y""\nz"\n')
    (tmp_path / "b.csv").write_text("Estado,Sprint\nTo Do,Sprint 2\n")
    rows = CS.canonical_issues(CS.read_issue_csv(spark, str(tmp_path))).collect()
    assert {(r.sprint, r.status) for r in rows} == {("Sprint 1", "Done"), ("Sprint 2", "To Do")}
