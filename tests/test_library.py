"""Library operators without a registered query: S13, S17, O12, K37, N7, A22, A25 long form."""

import datetime as dt
import tempfile


from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import topk as TK
from defectlens.operators import verify as V
from defectlens.sources import versions as VS


def test_source_info_and_switch(spark):
    log = spark.createDataFrame([("a.csv", 10, dt.datetime(2025, 1, 1)), ("b.csv", 20, dt.datetime(2025, 1, 2))],
                                "source_file_name string, total_bugs_loaded long, load_timestamp timestamp")
    assert VS.source_info(log).first().source_file_name == "b.csv"
    root, cur = tempfile.mkdtemp(prefix="dl-v-"), tempfile.mkdtemp(prefix="dl-c-") + "/cur"
    old = spark.createDataFrame([(1, "Sprint 1", "a")], "issue_id int, sprint string, assignee string")
    new = spark.createDataFrame([(2, "Sprint 2", "b"), (3, "Sprint 2", "c")], "issue_id int, sprint string, assignee string")
    VS.write_snapshot(old, root, "2025-01-01T00-00-00-000Z")
    new.write.parquet(cur)
    switched = VS.switch_version(spark, root, cur, "2025-01-01T00-00-00-000Z")
    assert [r.issue_id for r in switched.collect()] == [1]
    assert VS.read_snapshots(spark, root).select("version").distinct().count() == 2   # current was backed up


def test_max_pending_developer(spark):
    devs = spark.createDataFrame([("g", "bea", 5), ("g", "al", 5), ("g", "cy", 2), ("h", "dan", 1)],
                                 "g string, assignee string, pending long")
    got = {r.g: (r.assignee, r.pending) for r in TK.max_pending_developer(devs, ["g"]).collect()}
    assert got == {"g": ("al", 5), "h": ("dan", 1)}


def test_percentiles_and_long_pivot(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("m", "Sprint 1", "Done", base, base + dt.timedelta(days=d)) for d in (1, 2, 3, 4, 100)]
    rows.append(("m", "Sprint 1", "To Do", base, None))
    iss = spark.createDataFrame(rows, "module string, sprint string, status string, created_at timestamp_ntz, "
                                      "resolved_at timestamp_ntz")
    p = K.resolution_percentiles(iss, ["module"]).select("p50", "p90").first()
    assert p.p50 == 3 and abs(p.p90 - 61.6) < 1e-9
    lf = {(r.status): r.total for r in R.sprint_status_long(iss).collect()}
    assert lf == {"Done": 5, "To Do": 1}


def test_sanitize_and_team_totals(spark):
    summ = spark.createDataFrame([(-3, 0, 140.0)], "total_bugs long, tc_total long, test_automation double")
    r = V.sanitize_summary(summ).first()
    assert (r.total_bugs, r.tc_total, r.test_automation) == (0, 1, 100.0)
    devs = spark.createDataFrame([("a", 10, 4, 6), ("b", 5, 5, 0)], "assignee string, assigned long, resolved long, "
                                                                      "pending long")
    t = R.team_totals(devs).first()
    assert (t.developers, t.pending, t.assigned, t.efficiency) == (2, 6, 15, 60)
    sp = spark.createDataFrame([("S", 1, -2, 1, None)], "sprint string, sprint_num int, bugs long, bugs_resolved long, "
                                                        "velocity long")
    s = V.sanitize_sprints(sp).first()
    assert (s.bugs, s.velocity) == (0, 0)


def test_sorted_options_and_sprint_row_filter(spark):
    opts = spark.createDataFrame([("module", "b"), ("module", "Á"), ("module", "a")], "option string, value string")
    got = [r.value for r in TK.sorted_options(opts).orderBy("position").collect()]
    assert got == ["a", "Á", "b"]
    from defectlens.operators.filters import sprint_row_filter
    sp = spark.createDataFrame([("S1", ["UAT", "x"], "Web", "PROD"), ("S2", ["y"], "Mobile", "DEV"), ("S3", None, "web", "uat")],
                               "sprint string, tags array<string>, strategy string, environment string")
    assert [r.sprint for r in sp.filter(sprint_row_filter(tags=["uat"])).collect()] == ["S1"]
    assert [r.sprint for r in sp.filter(sprint_row_filter(strategy=["WEB"], environment=["All"])).orderBy("sprint")
            .collect()] == ["S1", "S3"]


def test_card_totals_fallback(spark):
    summ = spark.createDataFrame([("g", 100, 80, 90), ("h", 7, 5, 6)], "grp string, total_bugs long, tc_executed long, "
                                                                       "tc_total long")
    sel = spark.createDataFrame([("g", 3, 0, 4, 5)], "grp string, bugs long, bugs_found long, test_cases long, "
                                                      "test_planned long")
    got = {r.grp: (r.selected_sprints, r.bugs, r.executed, r.planned) for r in R.card_totals(sel, summ, ["grp"]).collect()}
    assert got == {"g": (1, 3, 4, 5), "h": (0, 7, 5, 6)}


def test_bug_series_change_field(spark):
    from defectlens.operators import trends as TR
    sp = spark.createDataFrame([("d", "Sprint 1", 1, 5, 2, 3, 5, 5, 2, 5, 7)],
                               "d string, sprint string, sprint_num int, bugs long, bugs_resolved long, bugs_pending long, "
                               "test_cases long, test_planned long, velocity long, planned_velocity long, change long")
    assert TR.sprint_trends(sp, ["d"]).first().change == 7
