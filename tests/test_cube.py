"""The roll-up cube: its views equal the separate roll-ups, and reports read the issues once."""

import datetime as dt

import pytest

from defectlens.operators import rollups as R
from defectlens.operators.cube import RollupCube
from defectlens.operators.sprints import sprint_frame
from defectlens.plans.catalog import load_all
from defectlens.plans.report import QualityReport
from defectlens.sources.adapter import loaded_tables
from tests.conftest import SF_SMALL

SCHEMA = ("environment string, module string, sprint string, sprint_num int, assignee string, priority string, status string, "
          "cases_executed long, cases_planned long, created_at date, resolved_at date, gid long, d_module string, k0 string, `set` string")
DAY = dt.date(2024, 1, 1)


def rows_of(df):
    return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.fixture(scope="module")
def odd_issues(spark):
    """Null and blank labels, a hot module, repeated rows, and columns named like the cube's own."""
    rows = []
    for k in range(400):
        module = None if k % 11 == 0 else "" if k % 7 == 0 else " POS " if k % 5 == 0 else "POS"
        sprint = None if k % 13 == 0 else k % 4
        rows.append((None if k % 9 == 0 else "PROD" if k % 2 else "SIT", module, None if sprint is None else f"Sprint {sprint}", sprint,
                     None if k % 6 == 0 else "" if k % 8 == 0 else f"p{k % 3}", None if k % 10 == 0 else "Alta" if k % 3 else "Baja",
                     None if k % 17 == 0 else ("Done", "To Do", "In Development")[k % 3], k % 5, 5, DAY,
                     None if k % 2 else DAY + dt.timedelta(k % 9), 99, "x", "y", "z"))
    return spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(3)


@pytest.mark.parametrize("by", [[], ["environment"], ["module"], ["environment", "priority"]])
def test_views_equal_the_separate_rollups(odd_issues, by):
    cube = RollupCube(odd_issues, by)
    assert rows_of(cube.sprints()) == rows_of(sprint_frame(odd_issues, by))
    assert rows_of(cube.developers()) == rows_of(R.assignee_rollup(odd_issues, by))
    assert rows_of(cube.pending()) == rows_of(R.assignee_pending(odd_issues, by))
    if "priority" not in by:
        assert rows_of(cube.priorities()) == rows_of(R.priority_breakdown(odd_issues, by))
    if "module" not in by:
        assert rows_of(cube.modules()) == rows_of(R.module_breakdown(odd_issues, by))
    else:
        assert cube.modules().columns == ["module", "label", "count", "pending", "percentage"]


def test_no_issues(odd_issues):
    cube = RollupCube(odd_issues.limit(0), ["environment"])
    assert not any(f().collect() for f in (cube.sprints, cube.developers, cube.pending, cube.modules, cube.priorities))
    assert QualityReport(odd_issues.limit(0), ["environment"]).all_rows().count() == 0


def test_report_of_odd_issues(odd_issues):
    got = {(r["environment"], r["part"], r["key"]): r["value"] for r in QualityReport(odd_issues, ["environment"]).all_rows().collect()}
    for env in (None, "PROD", "SIT"):
        own = odd_issues.filter(odd_issues.environment.eqNullSafe(env))
        assert got[env, "kpi", "total_bugs"] == own.count()
        assert got[env, "priority", "Alta"] == own.filter("priority = 'Alta' AND status IN ('To Do', 'In Development')").count()
    assert QualityReport(odd_issues).all_rows().filter("part = 'kpi' AND key = 'total_bugs'").first()["value"] == 405


@pytest.mark.parametrize("name", ["alerts_by_environment", "alerts_by_type", "rule_table_eval", "team_findings", "legacy_alerts", "report_all"])
def test_reports_read_the_cube_only(spark, name):
    """The cube's write is the one scan of the issues; each part then reads its own set's folder."""
    df = load_all()[name].fn(loaded_tables(spark, SF_SMALL))
    assert df.inputFiles() and all("/cube-" in f for f in df.inputFiles())
    assert "PartitionFilters: [isnotnull(set" in df._jdf.queryExecution().executedPlan().toString()
