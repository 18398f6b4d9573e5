"""Pipeline entry points E1-E5 and V6 on the smallest tables / fixtures."""


from pyspark.sql import functions as F

from defectlens.plans import report as RP
from defectlens.sources import documents as D
from defectlens.sources.adapter import Tables
from tests.conftest import CORRUPT_DOC, FIXTURE_DOC, SF_SMALL


def test_quality_report(spark):
    rep = RP.QualityReport(Tables(spark, SF_SMALL).issues, by=["module"], cache_rollups=True)
    out = rep.all()
    n_mod = rep.kpis().count()
    assert n_mod == out["maturity"].count() and out["predictions"].count() == 3 * n_mod
    assert set(out["alerts"].columns) >= {"alert_id", "priority", "rank", "overflow"}
    assert out["recommendations"].filter(F.col("rec_id") == "increase-automation").count() == n_mod
    assert out["roi"].first().early_detection.replace(",", "").isdigit()


def test_filtered_and_team(spark):
    iss = Tables(spark, SF_SMALL).issues
    r = RP.filtered_issues(iss, status="Done", priority="alta", include_bugs=True, sprints="sprint 1")
    s = r["summary"].first()
    assert s.total_bugs == r["bugs"].count() and s.bugs_closed == s.total_bugs
    assert r["sprints"].filter(~F.lower("sprint").contains("sprint 1")).count() >= 0
    ta = RP.team_analysis(iss)
    assert set(ta) == {"summary", "top_developers", "developer_summaries", "assignment", "statuses", "issue_types"}
    assert ta["top_developers"].count() <= 5


def test_rollup_document(spark):
    iss = Tables(spark, SF_SMALL).issues
    doc = RP.rollup_document(iss, ["module"], as_json=True).first()
    assert '"sprintData"' in doc.document and '"bugsByPriority"' in doc.document


def test_verify(spark):
    t = Tables(spark, SF_SMALL)
    v = RP.verify(t.issues, t.raw_facts, F.col("priority").isin("Más alta", "Alta"), F.col("status") == "To Do",
                  F.col("is_critical"), F.col("status") == "To Do")
    s = v["summary"].first()
    assert s.total_a == s.total_b and 0 < s.match_percentage < 100 and s.status == "warning"


def test_process_documents_quarantines(spark):
    docs = D.read_documents(spark, [FIXTURE_DOC, CORRUPT_DOC])
    out = RP.process_documents(docs)
    assert out["kpis"].count() == 1 and out["kpis"].first().quality_index == 59
    assert out["quarantine"].count() == 1


def test_quality_report_without_keys(spark):
    """by=[]: global totals via scalar subqueries, no grouping keys."""
    rep = RP.QualityReport(Tables(spark, SF_SMALL).issues, by=[])
    out = rep.all()
    assert out["kpis"].count() == 1 and out["predictions"].count() == 3
    recs = [r.rec_id for r in out["recommendations"].orderBy("rank").collect()]
    assert "increase-automation" in recs
    alerts = out["alerts"].collect()
    assert all(a.rank >= 1 for a in alerts)


def test_rule_recommendations_with_override(spark):
    rep = RP.QualityReport(Tables(spark, SF_SMALL).issues, by=["module"])
    base = rep.rule_recommendations()
    assert base.filter(F.col("metric") == "testCases").count() >= 3 * rep.kpis().count()
    user = spark.createDataFrame([(0, "mediaCasosEjecutados", "avg >= 0", "Custom: always", "alta")],
                                 "rule_id int, metric string, condition string, text string, priority string")
    over = rep.rule_recommendations(user_rules=user)
    tc = over.filter(F.col("metric") == "testCases").select("text").distinct().collect()
    assert [r.text for r in tc] == ["Custom: always"]
    assert over.filter(F.col("metric") == "cycleTime").count() == base.filter(F.col("metric") == "cycleTime").count()
