"""Literal edge-case frames (FIXTURES.md section 2)."""

import json


from defectlens.operators import filters as FL
from defectlens.operators import kpis as K
from defectlens.operators.sprints import sprint_frame
from defectlens.sources import documents as D
from defectlens.sources.adapter import Tables
from tests.conftest import SF_SMALL


def test_alias_chains_in_documents(spark, tmp_path):
    doc = {"sprintData": [{"sprint": "", "total": 0, "bugs": 5, "bugs_resueltos": 2},
                          {"sprint_num": 7, "bugs_encontrados": 3, "casos_ejecutados": 9},
                          {"sprint": "S3"}]}
    p = tmp_path / "aliases.json"
    p.write_text(json.dumps(doc))
    rows = {r.sprint_num: r for r in D.sprint_rows(D.read_documents(spark, str(p))).collect()}
    assert (rows[1].bugs, rows[1].bugs_resolved, rows[1].sprint) == (5, 2, "Sprint 1")   # total 0 falls through
    assert (rows[2].bugs, rows[2].test_cases) == (3, 9)
    assert (rows[3].bugs, rows[3].test_cases, rows[3].sprint) == (0, 0, "S3")


def test_closed_vocabularies(spark):
    df = spark.createDataFrame([("Done",), ("RESUELTO",), ("Cerrado",), ("closed",), ("In Review",), (None,),
                                ("Resolved - verified",)], "status string")
    exact = [r.status for r in df.filter(FL.closed_exact()).collect()]
    kw = [r.status for r in df.filter(FL.closed_keyword()).collect()]
    sql = [r.status for r in df.filter(FL.closed_sql()).collect()]
    assert exact == ["Done", "RESUELTO", "Cerrado", "closed"]
    assert kw == ["RESUELTO", "Cerrado", "closed", "Resolved - verified"]        # 'done' is not a keyword
    assert sql == ["Done"]                                                       # case-sensitive


def test_empty_issue_table_kpis(spark):
    empty = Tables(spark, SF_SMALL).issues.limit(0)
    r = K.kpis(sprint_frame(empty), []).first()
    assert (r.n_sprints, r.total_bugs, r.quality_index, r.avg_resolution_time) == (0, 0, 75, 7.0)
    assert (r.maturity_score, r.prediction_confidence, r.roi) == (1, 60, None)


def test_list_parameters():
    assert FL.parse_list(" Done, ,TO DO ") == ["done", "to do"]
    assert FL.parse_list("") is None and FL.parse_list(None) is None
    assert FL.parse_list(["A", "b"]) == ["a", "b"]
