"""Golden values worked out by hand from a whole document
(tests/golden_data.py), computed here through the document path."""

import os

import pytest
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import kpis as K
from defectlens.operators import trends as TR
from defectlens.sources import documents as D
from tests.conftest import CORRUPT_DOC, FIXTURE_DIR, FIXTURE_DOC


@pytest.fixture(scope="module")
def doc(spark):
    return D.read_documents(spark, FIXTURE_DOC)


@pytest.fixture(scope="module")
def sprints(doc):
    s = D.sprint_rows(doc, key="doc_path")
    return s.withColumn("critical_pending", F.lit(0)).withColumn("res_days_sum", F.lit(0)) \
        .withColumn("res_days_n", F.lit(0))


@pytest.fixture(scope="module")
def kpi(doc, sprints):
    summ = D.summary_row(doc, C.DEFAULT_PRIORITIES["critical"], C.CRITICAL_LABELS_ALL)
    return K.kpis(sprints, ["doc_path"], summary=summ).collect()[0].asDict()


def test_sprint_sums(sprints):
    r = sprints.agg(*[F.sum(c).alias(c) for c in
                      ("bugs", "bugs_resolved", "bugs_pending", "test_cases", "velocity", "planned_velocity")]
                    ).collect()[0]
    assert (r.bugs, r.bugs_resolved, r.bugs_pending, r.test_cases) == (1000, 239, 761, 1000)
    assert (r.velocity, r.planned_velocity) == (849, 1000)
    assert sprints.count() == 21


def test_kpis(kpi):
    assert kpi["avg_test_cases_per_sprint"] == 48          # K1
    assert kpi["resolution_efficiency"] == 17              # K2
    assert kpi["defect_density"] == 1.0                    # K3
    assert kpi["quality_index"] == 59                      # K4
    assert kpi["critical_count"] == 239                    # K6
    assert kpi["critical_ratio"] == 24                     # K7
    assert kpi["critical_pending"] == 0                    # K8
    assert kpi["avg_resolution_time"] == 1.2               # K9
    assert kpi["test_execution_rate"] == 100               # K10
    assert kpi["leakage_rate"] == 0 and kpi["escape_rate"] == 0   # K11, K12
    assert kpi["rework_rate"] == 15                        # K13
    assert kpi["first_pass_yield"] == 17                   # K14
    assert kpi["burndown_efficiency"] == 85                # K15
    assert kpi["avg_bugs_per_sprint"] == 48                # K16
    assert abs(kpi["consistency"] - 0.755595631701504) < 1e-6   # K17
    assert kpi["prediction_confidence"] == 76             # K18
    assert kpi["maturity_score"] == 4                      # K19 (D10 off)
    assert kpi["savings"] == 4500000 and kpi["roi"] == 900  # K20
    assert kpi["next_sprint_bugs"] == 30 and kpi["next_sprint_trend"] == "down"  # K21
    assert (kpi["quality_prediction"], kpi["quality_direction"]) == (80, "up")   # K22
    assert kpi["sprint_trend"] == -38                      # W1


def test_maturity_with_predictions(doc, sprints):
    summ = D.summary_row(doc, C.DEFAULT_PRIORITIES["critical"], C.CRITICAL_LABELS_ALL)
    cfg = C.Config(count_predictions_in_maturity=True)
    r = K.kpis(sprints, ["doc_path"], cfg, summary=summ).collect()[0]
    assert r.maturity_score == 5


def test_cycle_time(doc, sprints):
    prio = D.map_rows(doc, "bugsByPriority").select(
        "doc_path", F.col("label").alias("priority"), F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("resolved", F.lit(0)).alias("resolved"))
    r = K.cycle_time(sprints, prio, ["doc_path"]).collect()[0]
    assert r.cycle_time == 58.6                            # K24
    assert (r.critical_days, r.high_days, r.medium_days, r.low_days) == (29, 47, 58.6, 88)  # K25


def test_series(sprints):
    t = {r.sprint_num: r for r in TR.sprint_trends(sprints, ["doc_path"]).collect()}
    assert [t[i].resolution_rate for i in (1, 2, 3, 4, 20, 21)] == [41, 20, 26, 23, 40, 8]      # W3
    assert [t[i].quality for i in (1, 2, 3, 4, 20, 21)] == [30, 15, 0, 28, 57, 55]               # W4
    assert [t[i].velocity_efficiency for i in (1, 20, 21)] == [85, 84, 83]                       # W5
    v = {r.sprint_num: r.change for r in TR.velocity_change(sprints, ["doc_path"]).collect()}
    assert [v[i] for i in (1, 2, 3, 4, 5)] == [0, 18, 41, -40, 36]                               # W6


def test_half_split_and_comparison(sprints):
    h = TR.half_split_trends(sprints, ["doc_path"]).collect()[0]
    assert (h.test_cases_trend, h.resolution_trend) == (-4, 3)                                   # W9
    c = {r.metric: r for r in TR.sprint_comparison(sprints, ["doc_path"]).collect()}
    b = c["bugs"]
    assert (b.previous, b.current, b.mean, b.delta, b.delta_pct, b.delta_mean, b.delta_mean_pct) == \
        (25, 24, 47.6, -1, -4, -23.6, -50)                                                       # W11


def test_corrupt_document_quarantined(spark):
    docs = D.read_documents(spark, CORRUPT_DOC)
    good, bad = D.split_corrupt(docs)
    assert bad.count() == 1 and good.count() == 0


def test_latest_document(spark):
    r = D.latest_document(spark, FIXTURE_DIR).collect()[0]
    assert r.path.endswith(".json")


def test_empty_document(spark, tmp_path):
    """Golden for the empty input (processed output of the empty document):
    quality index 75, resolution time 7, maturity 1/5 Inicial, confidence 60,
    one alert (low-test-coverage), two recommendations, ROI null."""
    from defectlens.operators import rules as RU
    p = tmp_path / "empty.json"
    p.write_text("{}")
    doc = D.read_documents(spark, str(p))
    sprints = D.sprint_rows(doc).withColumns({"critical_pending": F.lit(0), "res_days_sum": F.lit(0),
                                              "res_days_n": F.lit(0)})
    summ = D.summary_row(doc, C.DEFAULT_PRIORITIES["critical"], C.CRITICAL_LABELS_ALL)
    k = K.kpis(sprints, ["doc_path"], summary=summ)
    r = k.collect()[0]
    assert (r.quality_index, r.avg_resolution_time, r.maturity_score, r.maturity_level) == (75, 7.0, 1, "Inicial")
    assert r.prediction_confidence == 60 and r.roi is None and r.total_bugs == 0
    devs = spark.createDataFrame([], "doc_path string, assignee string, pending long")
    mods = spark.createDataFrame([], "doc_path string, module string, percentage long")
    al = RU.alerts(k, devs, mods, ["doc_path"]).collect()
    assert [a.alert_id for a in al] == ["low-test-coverage"]
    ov = spark.createDataFrame([], "doc_path string, overloaded_assignee string")
    recs = RU.recommendations(k, ov, ["doc_path"]).orderBy("rank").collect()
    assert [x.rec_id for x in recs] == ["improve-test-coverage", "increase-automation"]


def test_validate_document(spark, tmp_path):
    p = tmp_path / "partial.json"
    p.write_text('{"summary": {"bugsClosed": 1}, "sprintData": []}')
    docs = D.read_documents(spark, [FIXTURE_DOC, str(p)])
    from defectlens.operators.verify import validate_document
    res = {os.path.basename(r.doc_path): r for r in validate_document(docs).collect()}
    assert res[os.path.basename(FIXTURE_DOC)].is_valid
    bad = res["partial.json"]
    assert not bad.is_valid and bad.errors == ["Invalid totalBugs in summary", "Invalid testCasesTotal in summary",
                                               "DeveloperData should be an array"]
