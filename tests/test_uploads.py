"""Uploads: a header a file in stream and batch, the version pointer, row-level snapshot differences."""

import os

import pytest
from pyspark.sql import functions as F

from defectlens.operators import snapshot_rows as SR
from defectlens.session import scratch_path
from defectlens.sources import csv_source as CS
from defectlens.sources import header_map as HM
from defectlens.sources import releases as RL
from defectlens.streaming import jobs as J

SPANISH = 'Sprint,Estado,Prioridad,Resumen,Módulo,Estado\r\nSprint 1,Done,Alta,"a, ""b""\nc",POS,other\r\n\r\nSprint 2,,Baja\r\n'
ENGLISH = "Priority;x,Status,SPRINT,Unknown\n".replace(";x", "") + "Baja,To Do,Sprint 2,?\nAlta,Done, Sprint 10 ,\n"
FIELDS = ["sprint", "sprint_num", "status", "priority", "summary", "module"]


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=str)


WANT = sorted([("Sprint 1", 1, "Done", "Alta", 'a, "b"\nc', "POS"), ("Sprint 2", 2, None, "Baja", None, None),
               ("Sprint 2", 2, "To Do", "Baja", None, None), ("Sprint 10", 10, "Done", "Alta", None, None)], key=str)


@pytest.mark.parametrize("max_files", [1, 8])
def test_two_headers_give_equal_rows_in_batch_and_stream(spark, max_files):
    d = J.new_dirs(spark, "t2-headers")
    write(d["src"], one=SPANISH, two=ENGLISH, three="foo,bar\nSprint 9,x\n", four="")
    J.run_to_completion(J.csv_ingest_stream(spark, d["src"], d["table"], d["dim"], d["ckpt"], max_files=max_files))
    assert rows_of(J.read_epochs(spark, d["table"])) == WANT
    batch = HM.in_file_order(HM.read_cells(spark, d["src"]))
    assert rows_of(HM.issues_of(batch, HM.file_headers(batch))) == WANT
    assert rows_of(CS.canonical_issues(CS.read_issue_csv(spark, [os.path.join(d["src"], f"{n}.csv") for n in ("one", "two")]))) == WANT
    rejected = J.read_rejected(spark, f"{d['table']}_rejected").collect()
    assert [(os.path.basename(r.file), r.reason, r.header.startswith("foo,bar")) for r in rejected] == [("three.csv", "no issue field in the header", True)]
    got = {r.sprint: r.total for r in J.summed_rollup(spark, f"{d['table']}_rollup").collect()}
    assert got == {"Sprint 1": 1, "Sprint 2": 2, "Sprint 10": 1}
    dim = J.read_latest_epoch(spark, d["dim"]).collect()
    assert {r.sprint for r in dim} == set(got) and len(dim) == 3


def test_only_rejected_or_empty_files(spark):
    d = J.new_dirs(spark, "t2-none")
    write(d["src"], a="foo,bar\n1,2\n", b="", c=",".join(f"sprint{i}" for i in range(150)) + "\n1\n")
    J.run_to_completion(J.csv_ingest_stream(spark, d["src"], d["table"], d["dim"], d["ckpt"], max_files=8))
    assert sorted(r.reason for r in J.read_rejected(spark, f"{d['table']}_rejected").collect()) == \
        ["more than 100 columns", "no issue field in the header"]
    assert J.read_rejected(spark, d["table"] + "_none").count() == 0


def test_repeated_and_odd_header_names(spark):
    d = J.new_dirs(spark, "headers")
    write(d["src"], a="  Fix Version ,A,a, a!,Á,fix_version\n1,2,3,4,5,6\n")
    rows = HM.in_file_order(HM.read_cells(spark, d["src"]))
    names = HM.file_headers(rows).first().names[:6]
    assert names == ["fix_version", "a", "a_2", "a_", "_", "fix_version_2"]
    assert [c for c in CS.read_issue_csv(spark, d["src"]).columns if c != "source_file"] == names
    assert [r.fix_version for r in HM.issues_of(rows, HM.file_headers(rows)).collect()] == ["1"]


ISSUES = "issue_id long, sprint string, status string, priority string, assignee string, issue_type string"


@pytest.fixture
def issues(spark):
    return lambda n, status: spark.createDataFrame([(i, f"Sprint {i % 4}", status, "Major", f"u{i % 3}", "Bug") for i in range(n)], ISSUES)


def seen(rel):
    return rel.issues().count(), rel.rollup("by_sprint").agg(F.sum("total")).first()[0], rel.versions()


def test_pointer_moves_last_and_old_versions_go(spark, issues):
    rel = RL.Releases(spark, scratch_path(spark, "rel"))
    assert rel.current_version() is None and rel.versions() == [] and rel.log().count() == 0
    with pytest.raises(ValueError):
        rel.issues()
    rel.publish(issues(8, "To Do"), "v1")
    assert seen(rel) == (8, 8, ["v1"])

    def broken(df):
        raise RuntimeError("no roll-up")
    half = RL.Releases(spark, rel.root, rollups={"by_sprint": rel.rollups["by_sprint"], "bad": broken})
    with pytest.raises(RuntimeError):
        half.publish(issues(99, "Done"), "v2")
    assert seen(rel) == (8, 8, ["v1"]) and "v2" in rel._folders("versions")  # half a load: nobody sees it
    with pytest.raises(ValueError):
        rel.switch("v2")
    rel.publish(issues(10, "Done"), "v3")
    assert seen(rel) == (10, 10, ["v1", "v3"]) and rel._folders("versions") == ["v1", "v3"]  # the broken load is gone
    rel.switch("v1")
    assert seen(rel) == (8, 8, ["v1", "v3"])
    rel.publish(issues(12, "Done"), "v4")
    assert seen(rel) == (12, 12, ["v3", "v4"])
    assert [(r.seq, r.version, r.action) for r in rel.log().orderBy("seq").collect()] == \
        [(0, "v1", "load"), (1, "v3", "load"), (2, "v1", "switch"), (3, "v4", "load")]
    got = [(r.version, r["rank"], r.active, r.bugs, r.sprints, r.developers) for r in rel.version_list().orderBy("rank").collect()]
    assert got == [("v4", 1, True, 12, 4, 3), ("v3", 2, False, 10, 4, 3)]
    with pytest.raises(ValueError):
        rel.publish(issues(1, "Done"), "v4")
    with pytest.raises(ValueError):
        rel.switch("v1")


def test_a_reader_keeps_its_version_during_a_load(spark, issues):
    rel = RL.Releases(spark, scratch_path(spark, "rel"))
    rel.publish(issues(4, "To Do"), "v1")
    tables = rel.tables()
    rel.publish(issues(9, "Done"), "v2")
    assert tables["issues"].count() == tables["by_sprint"].agg(F.sum("total")).first()[0] == 4
    assert rel.tables()["issues"].count() == 9


def test_second_of_two_writers_fails(spark, issues, monkeypatch):
    rel = RL.Releases(spark, scratch_path(spark, "rel"))
    rel.publish(issues(4, "To Do"), "v1")
    other = RL.Releases(spark, rel.root)
    monkeypatch.setattr(other, "_folders", lambda name, old=rel._folders("pointer"): [] if name == "pointer" else rel._folders(name))
    with pytest.raises(Exception, match="exists"):
        other.switch("v1")
    assert rel.log().count() == 1


ROWS = "k long, g int, a string, b string"


def diff(spark, old, new, buckets=8, schema=(ROWS, ROWS)):
    root = scratch_path(spark, "diff")
    for v, rows, s in (("1", old, schema[0]), ("2", new, schema[1])):
        SR.write_snapshot(spark.createDataFrame(rows, s), root, v, SR.bucket_of("g", buckets=buckets))
    got = SR.row_diff(spark, root, "1", "2", ["k"])
    return root, got, sorted(((r.k, r.change, r.changes and [tuple(c) for c in r.changes]) for r in got.collect()), key=str)


def test_added_removed_changed_moved_and_nulls(spark):
    old = [(i, i % 10, "x", None if i % 3 else "") for i in range(200)] + [(None, 3, "n", "n")]
    new = [r for r in old if r[0] not in (5, 13, 33, None)] + [(5, 6, "x", None), (33, 3, "y", None), (900, 3, "x", "")]
    _, _, got = diff(spark, old, new)
    assert got == sorted([(5, "changed", [("g", "5", "6")]), (13, "removed", None), (None, "removed", None), (900, "added", None),
                          (33, "changed", [("a", "x", "y"), ("b", "", None)])], key=str)


def test_repeated_keys_pair_up(spark):
    old = [(1, 1, "x", "p"), (1, 1, "x", "p"), (1, 1, "y", "q"), (2, 1, "z", "z")]
    _, _, same = diff(spark, old, list(reversed(old)))
    assert same == []
    _, _, got = diff(spark, old, old + [(2, 1, "z", "z")])
    assert got == [(2, "added", None)]


def test_new_column_and_empty_snapshots(spark):
    old, new = [(1, 1, "x", "p"), (2, 2, "x", "p")], [(1, 1, "x", "p", None), (2, 2, "x", "p", "new")]
    _, _, got = diff(spark, old, new, schema=(ROWS, ROWS + ", c string"))
    assert got == [(2, "changed", [("c", None, "new")])]


def test_only_differing_buckets_are_read(spark):
    old = [(i, i % 10, "x", "y") for i in range(1000)]
    new = [(k, g, "changed" if g == 4 else a, b) for k, g, a, b in old]
    root, df, got = diff(spark, old, new, buckets=64)
    assert len(got) == 100 and all(g[1] == "changed" for g in got)
    buckets = SR.differing_buckets(spark, root, "1", "2")
    assert len(buckets) == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and "PartitionFilters: []" not in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in SR.read_snapshot(spark, root, "2", buckets).inputFiles()}
    assert read <= {str(b) for b in range(64)}
    assert SR.read_snapshot(spark, root, "2", buckets).select("g").distinct().count() < 10
