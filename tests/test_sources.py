"""CSV edge cases (S1-S3), load log (S12), dimension upsert (S10), snapshots."""

import os
import tempfile


from defectlens.sources import csv_source as CS
from defectlens.sources import versions as VS

HEADER = 'Sprint,Estado,Prioridad,Resumen,Módulo,Versión,Módulo'
# One file with CRLF line ends and a blank line, one with LF, a quoted
# comma, doubled quotes, a newline inside quotes and a short row.
CRLF = (HEADER + '\r\nSprint 1,To Do,Alta,"a, b",POS,v1,X\r\n\r\n'
        'Sprint 2,Done,Media,"say ""hi""",BOT,v2,Y\r\n')
LF = HEADER + '\nSprint 2,Done,Baja,"line1\nline2",POS,v2,Z\nSprint 10,To Do\n'
CSV = [CRLF, LF]


def _write(texts):
    d = tempfile.mkdtemp(prefix="dl-csv-")
    for i, text in enumerate(texts):
        with open(os.path.join(d, f"in{i}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return d


def test_csv_edge_cases(spark):
    rows = CS.read_issue_csv(spark, _write(CSV))
    assert [c for c in rows.columns if c != "source_file"] == \
        ["sprint", "estado", "prioridad", "resumen", "m_dulo", "versi_n", "m_dulo_2"]
    iss = CS.canonical_issues(rows).orderBy("sprint_num", "summary").collect()
    assert len(iss) == 4                                     # blank line skipped
    assert iss[0].summary == "a, b" and iss[0].module == "POS"
    s2 = sorted(r.summary for r in iss if r.sprint == "Sprint 2")
    assert s2 == ["line1\nline2", 'say "hi"']
    short = [r for r in iss if r.sprint == "Sprint 10"][0]
    assert short.priority is None and short.summary is None and short.sprint_num == 10
    assert iss[0].fix_version == "v1"


def test_load_log_and_dimension(spark):
    path = _write(CSV)
    rows = CS.read_issue_csv(spark, path)
    logs = CS.load_log(rows).collect()
    assert sum(r.total_bugs_loaded for r in logs) == 4 and len(logs) == 2
    assert all(r.status == "success" and r.source_file_size > 0 for r in logs)
    dim = CS.sprint_dimension(CS.canonical_issues(rows))
    assert sorted((r.sprint, r.sprint_num) for r in dim.collect()) == \
        [("Sprint 1", 1), ("Sprint 10", 10), ("Sprint 2", 2)]
    new = spark.createDataFrame([("Sprint 2", 22), ("Sprint 3", 3)], "sprint string, sprint_num int")
    up = {r.sprint: r.sprint_num for r in CS.upsert_dimension(dim, new).collect()}
    assert up == {"Sprint 1": 1, "Sprint 10": 10, "Sprint 2": 22, "Sprint 3": 3}


def test_snapshots(spark):
    root = tempfile.mkdtemp(prefix="dl-ver-")
    df = spark.createDataFrame([(1, "Sprint 1", "a"), (2, "Sprint 2", None)], "issue_id int, sprint string, assignee string")
    for v in ("2025-01-01", "2025-01-02", "2025-01-03"):
        VS.write_snapshot(df, root, v)
    snaps = spark.read.parquet(root)
    vl = {r.version: r for r in VS.version_list(snaps, keep=2).collect()}
    assert vl["2025-01-03"].active and vl["2025-01-03"].rank == 1
    assert vl["2025-01-01"].retain is False and vl["2025-01-02"].bugs == 2 and vl["2025-01-02"].developers == 1
    drop = VS.versions_to_drop(snaps, keep=2)
    assert drop == ["2025-01-01"]
    VS.drop_versions(spark, root, drop)
    assert sorted(r.version for r in VS.read_snapshots(spark, root).select("version").distinct().collect()) == \
        ["2025-01-02", "2025-01-03"]
    assert VS.read_version(spark, root, "2025-01-02").count() == 2
    assert VS.version_id().endswith("Z")
