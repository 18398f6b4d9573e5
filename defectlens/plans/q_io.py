"""Source / sink / snapshot / streaming queries (S*, T*, V7).

Each writes only below ``spark.checkpoint.dir`` (a fresh folder per call)
and returns a DataFrame read back from what Spark wrote, so the whole
round trip is checked against the same oracle as the batch query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import rollups as R
from defectlens.operators import snapshot_rows as SR
from defectlens.operators.rollups import join_null_safe
from defectlens.operators.sprints import sprint_frame
from defectlens.plans import q_rollups  # noqa: F401 - registers the batch roll-ups first
from defectlens.plans.catalog import REGISTRY, register
from defectlens.plans.q_kpis import sprint_cte
from defectlens.plans.sqlfrag import lst, with_issue
from defectlens.session import scratch_path
from defectlens.sources import csv_source as CS
from defectlens.sources import documents as D
from defectlens.sources import header_map as HM
from defectlens.sources import releases as RL
from defectlens.sources import versions as VS
from defectlens.streaming import jobs as J

A1_SQL = f"""SELECT sprint, count(*) AS total, count_if(priority IN ({lst(C.SPRINT_VIEW_CRITICAL)})) AS critical,
       count_if(status IN ({lst(C.PENDING_STATUS_SPRINT_VIEW)})) AS pending,
       count_if(status IN ({lst(C.CANCELED_STATUS)})) AS canceled"""

# The upload file's header row (Spanish, with accents).
CSV_HEADERS = {"sprint": "Sprint", "priority": "Prioridad", "status": "Estado", "assignee": "Asignado a",
               "issue_type": "Tipo Incidencia", "summary": "Resumen", "module": "Módulo",
               "category": "Categoría", "environment": "Ambiente", "strategy": "Estrategia",
               "fix_version": "Versión", "tags_text": "Tags"}


# The header row of an upload from an English tracker, in another order.
ENGLISH_HEADERS = {"status": "Status", "summary": "Summary", "sprint": "SPRINT", "tags_text": "Tag", "fix_version": "Fix Version",
                   "assignee": "Assignee", "module": "Module", "category": "Category", "environment": "Environment",
                   "strategy": "Strategy", "issue_type": "Issue type", "priority": "Priority"}


def _csv_issues(t):
    """Issues whose text has commas, quotes and newlines."""
    return t.issues.withColumn("summary", F.concat(F.col("summary"), F.lit(', "'), F.coalesce("status", F.lit("")),
                                                   F.lit('"\n'), F.coalesce(F.nullif("module", F.lit("")), F.lit("-")))) \
        .withColumn("tags_text", F.array_join("tags", "|"))


def _csv_input(t) -> str:
    """Issues as CSV files (written in parallel, one per task)."""
    path = scratch_path(t.spark, "csv")
    CS.write_issue_csv(_csv_issues(t), path, CSV_HEADERS)
    return path


def _mixed_csv_input(t) -> str:
    """Issues as CSV files of two trackers in one folder: other names and another order of columns."""
    path, iss = scratch_path(t.spark, "csv-mixed"), _csv_issues(t)
    english = F.col("issue_type").eqNullSafe("Bug")
    CS.write_issue_csv(iss.filter(~english), path, CSV_HEADERS)
    CS.write_issue_csv(iss.filter(english), path, ENGLISH_HEADERS, mode="append")
    return path


@register("csv_roundtrip", "S1 S2 S3 N4 N16 X7 (CSV of two header layouts with quotes/newlines -> A1)", with_issue(
    A1_SQL + ", count(*) AS multiline_rows, min(sprint_num) AS sprint_num, CAST(sum(len(tags)) AS BIGINT) AS tag_count FROM issue GROUP BY sprint"))
def q_csv_roundtrip(t):
    landed = scratch_path(t.spark, "csv-cells")

    def land(rows):
        rows.write.mode("overwrite").parquet(landed)
        return t.spark.read.schema(rows.schema).parquet(landed)

    rows = HM.land_cells(t.spark, _mixed_csv_input(t), land)
    iss = HM.issues_of(rows, HM.file_headers(rows))
    is_in = lambda c, labels: F.col(c).isin(list(labels))
    return iss.groupBy("sprint").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_in("priority", C.SPRINT_VIEW_CRITICAL)).alias("critical"),
        F.count_if(is_in("status", C.PENDING_STATUS_SPRINT_VIEW)).alias("pending"),
        F.count_if(is_in("status", C.CANCELED_STATUS)).alias("canceled"),
        F.count_if(F.col("summary").contains("\n")).alias("multiline_rows"), F.min("sprint_num").alias("sprint_num"),
        F.sum(F.size("tags")).alias("tag_count"))


@register("json_document_sections", "S11 S4 S5 N1 (documents per module -> sprint rows)", with_issue("""
SELECT module, sprint, CAST(row_number() OVER (PARTITION BY module ORDER BY sprint_num) AS INTEGER) AS position,
  bugs, bugs_resolved, bugs_pending, test_cases, test_planned, velocity, planned_velocity FROM sprint""",
    sprint_cte(["module"])))
def q_json_document_sections(t):
    sp = sprint_frame(t.issues, ["module"])
    docs = D.issues_to_documents(sp, ["module"]).withColumn(
        "metadata", F.struct(F.col("module").alias("source"))).drop("module")
    path = scratch_path(t.spark, "docs")
    D.write_documents(docs, path)
    back = D.read_documents(t.spark, path, multi_line=False).withColumn("module", F.col("metadata.source"))
    rows = D.sprint_rows(back, key="module")
    return rows.select("module", "sprint", F.col("sprint_num").alias("position"), "bugs", "bugs_resolved",
                       "bugs_pending", "test_cases", "test_planned", "velocity", "planned_velocity")


@register("snapshot_versions", "S14 S15 S16 O11 V7 (three versions, keep two)", with_issue("""
SELECT CAST(r AS INTEGER) AS rank, r = 1 AS active, r <= 2 AS retain, count(*) AS bugs,
  count(DISTINCT sprint) AS sprints, count(DISTINCT assignee) AS developers,
  CASE WHEN r = 3 THEN NULL ELSE CAST(0 AS BIGINT) END AS bugs_delta
FROM issue, (VALUES (1), (2), (3)) AS v(r) GROUP BY r"""))
def q_snapshot_versions(t):
    root = scratch_path(t.spark, "versions")
    iss = t.issues.select("issue_id", "sprint", "assignee", "status")
    for v in ("2025-01-01T00-00-00-000Z", "2025-01-02T00-00-00-000Z", "2025-01-03T00-00-00-000Z"):
        VS.write_snapshot(iss, root, v)
    snaps = t.spark.read.parquet(root)
    vl = VS.version_list(snaps, keep=2)
    from defectlens.operators.verify import snapshot_diff
    return snapshot_diff(vl).select("rank", "active", "retain", "bugs", "sprints", "developers", "bugs_delta")


@register("stream_issues_by_sprint", "T1 (file stream, complete mode, availableNow) = A1", with_issue(
    A1_SQL + " FROM issue GROUP BY sprint"))
def q_stream_issues_by_sprint(t):
    return _streamed(t, R.issues_by_sprint)


def _streamed(t, rollup):
    """The issue table replayed as a file stream into a roll-up."""
    d = J.new_dirs(t.spark, "t1")
    src = t.issue_path or J.write_for_replay(t.issues, d["src"])
    schema = t.spark.read.parquet(src).schema
    J.run_to_completion(J.sprint_rollup_stream(t.spark, src, schema, d["sink"], d["ckpt"], max_files=J.FILES_PER_TRIGGER,
                                               rollup=rollup, versioned=True))
    return J.read_latest_epoch(t.spark, d["sink"])


@register("stream_issues_by_priority", "T1 (A2 kept current)", with_issue("""
SELECT priority, count(*) AS total, count_if(status IN ('To Do', 'In Development')) AS pending FROM issue GROUP BY priority"""))
def q_stream_issues_by_priority(t):
    return _streamed(t, R.issues_by_priority)


@register("stream_assignee_summary", "T1 (A8 kept current)", REGISTRY["assignee_summary"].sql)
def q_stream_assignee_summary(t):
    return _streamed(t, R.assignee_summary)


@register("stream_csv_ingest", "T2 S2 S10 U6 (CSV drop folder of two header layouts -> table, roll-up, dimension) = A1", with_issue(
    A1_SQL + """, (SELECT count(DISTINCT sprint) FROM issue) AS dim_sprints, count(DISTINCT status) AS statuses,
  count(DISTINCT module) FILTER (module <> '') AS modules, 0 AS rejected_files FROM issue GROUP BY sprint"""))
def q_stream_csv_ingest(t):
    d = J.new_dirs(t.spark, "t2")
    src = _mixed_csv_input(t)
    J.run_to_completion(J.csv_ingest_stream(t.spark, src, d["table"], d["dim"], d["ckpt"], max_files=J.FILES_PER_TRIGGER))
    table = J.read_epochs(t.spark, d["table"])
    dim = J.read_latest_epoch(t.spark, d["dim"])
    labels = table.groupBy("sprint").agg(F.count_distinct("status").alias("statuses"), F.count_distinct("module").alias("modules"))
    rejected = J.read_rejected(t.spark, f"{d['table']}_rejected").select(F.count(F.lit(1)).cast("int")).scalar()
    return join_null_safe(J.summed_rollup(t.spark, f"{d['table']}_rollup"), labels, ["sprint"]) \
        .withColumn("dim_sprints", dim.select(F.count(F.lit(1))).scalar()).withColumn("rejected_files", rejected)


@register("upload_versions", "T2 S14 S15 S16 S17 O11 (two loads, one that fails, a switch back; version pointer)", with_issue("""
SELECT step, CASE WHEN step IN (1, 4) THEN 1 ELSE 2 END AS version_seen, CASE WHEN step = 1 THEN 1 ELSE 2 END AS versions_left,
  count(*) AS bugs, count_if(CASE WHEN step IN (1, 4) THEN FALSE ELSE status = 'Done' END) AS done, count(DISTINCT sprint) AS sprints,
  count(*) AS rollup_total, count_if(CASE WHEN step IN (1, 4) AND status = 'Done' THEN TRUE ELSE status = 'To Do' END) AS rollup_pending
FROM issue, (VALUES (1), (2), (3), (4)) AS v(step) GROUP BY step"""))
def q_upload_versions(t):
    """What a reader sees after: a load of the issues before any was done, a load of the issues, a load that
    fails after its rows are written, a switch to the older version."""
    issues = t.issues.select("issue_id", "sprint", "status", "priority", "assignee", "issue_type")
    earlier = issues.withColumn("status", F.when(F.col("status") == "Done", "To Do").otherwise(F.col("status")))
    rel = RL.Releases(t.spark, scratch_path(t.spark, "releases"))
    seen, numbers = [], {}

    def look(step: int) -> None:
        version = rel.current_version()
        numbers.setdefault(version, len(numbers) + 1)
        facts = rel.issues().agg(F.count(F.lit(1)).alias("bugs"), F.count_if(F.col("status") == "Done").alias("done"),
                                 F.count_distinct("sprint").alias("sprints"))
        sums = rel.rollup("by_sprint").agg(F.sum("total").alias("rollup_total"), F.sum("pending").alias("rollup_pending"))
        left = F.lit(len(rel.versions())).alias("versions_left")
        both = facts.withColumn("_1", F.lit(1)).join(sums.withColumn("_1", F.lit(1)), "_1").drop("_1")  # two rows of one each
        path = scratch_path(t.spark, "seen")
        both.select(F.lit(step).alias("step"), F.lit(numbers[version]).alias("version_seen"), left, "*").write.parquet(path)
        seen.append(path)

    first = rel.publish(earlier)
    look(1)
    rel.publish(issues)
    look(2)

    def broken(_issues):
        raise RuntimeError("the roll-up failed")

    try:
        RL.Releases(t.spark, rel.root, rollups={"by_sprint": broken}).publish(earlier)
    except RuntimeError:
        look(3)
    rel.switch(first)
    look(4)
    return t.spark.read.parquet(*seen)


_DIFF_SQL = """
one AS (SELECT issue_id, min(sprint_num) AS sprint_num, min(status) AS status, min(assignee) AS assignee, min(priority) AS priority,
          min(issue_type) AS issue_type FROM issue GROUP BY issue_id),
newest AS (SELECT max(sprint_num) AS s FROM one),
v1 AS (SELECT issue_id, sprint_num, CASE WHEN sprint_num = s - 1 AND status = 'Done' THEN 'To Do' ELSE status END AS status, assignee, priority
       FROM one, newest WHERE sprint_num < s),
v2 AS (SELECT issue_id, sprint_num, status, assignee, priority FROM one),
v3 AS (SELECT issue_id, CASE WHEN sprint_num = s - 2 AND priority = 'Major' THEN s ELSE sprint_num END AS sprint_num, status,
         CASE WHEN sprint_num = s AND assignee IS NULL THEN 'triage' ELSE assignee END AS assignee,
         CASE WHEN sprint_num = s AND assignee IS NULL AND priority = 'Baja' THEN 'Media' ELSE priority END AS priority
       FROM one, newest WHERE NOT (sprint_num = s AND issue_type IS NOT DISTINCT FROM 'Sugerencia')),
pairs AS (
  SELECT 2 AS step, coalesce(a.issue_id, b.issue_id) AS issue_id, a.issue_id IS NULL AS fresh, b.issue_id IS NULL AS gone, a, b
  FROM v1 a FULL JOIN v2 b ON a.issue_id = b.issue_id
  UNION ALL
  SELECT 3, coalesce(a.issue_id, b.issue_id), a.issue_id IS NULL, b.issue_id IS NULL, a, b FROM v2 a FULL JOIN v3 b ON a.issue_id = b.issue_id
), named AS (
  SELECT step, issue_id, fresh, gone, array_to_string(list_filter([
    CASE WHEN a.assignee IS DISTINCT FROM b.assignee THEN 'assignee:' || coalesce(a.assignee, '-') || '>' || coalesce(b.assignee, '-') END,
    CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority:' || coalesce(a.priority, '-') || '>' || coalesce(b.priority, '-') END,
    CASE WHEN a.sprint_num IS DISTINCT FROM b.sprint_num THEN 'sprint_num:' || a.sprint_num || '>' || b.sprint_num END,
    CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status:' || coalesce(a.status, '-') || '>' || coalesce(b.status, '-') END],
    lambda x: x IS NOT NULL), ' ') AS changes FROM pairs)"""


@register("snapshot_row_diff", "V7 S14 (rows added, removed and changed between three versions)", with_issue("""
SELECT step, issue_id, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN NOT fresh AND NOT gone THEN changes END AS changes
FROM named WHERE fresh OR gone OR changes <> ''""", _DIFF_SQL))
def q_snapshot_row_diff(t):
    """The newest sprint arrives; then part of it is withdrawn, triaged and takes issues of an older sprint.
    Of an issue id that stands in several rows, the least values are taken."""
    bucket = SR.bucket_of("sprint_num")
    issues = SR.once_per_key(t.issues.select("issue_id", "sprint_num", "status", "assignee", "priority", "issue_type"), "issue_id",
                             scratch_path(t.spark, "issues-once"), bucket)
    last = issues.select(F.max("sprint_num")).scalar()
    c = F.col
    v1 = issues.filter(c("sprint_num") < last).withColumn(
        "status", F.when((c("sprint_num") == last - 1) & (c("status") == "Done"), "To Do").otherwise(c("status")))
    untriaged = (c("sprint_num") == last) & c("assignee").isNull()
    v3 = issues.filter(~((c("sprint_num") == last) & c("issue_type").eqNullSafe("Sugerencia"))).withColumns({
        "sprint_num": F.when((c("sprint_num") == last - 2) & (c("priority") == "Major"), last).otherwise(c("sprint_num")),
        "assignee": F.when(untriaged, "triage").otherwise(c("assignee")),
        "priority": F.when(untriaged & (c("priority") == "Baja"), "Media").otherwise(c("priority"))})
    root = scratch_path(t.spark, "row-snapshots")
    for name, df in (("1", v1), ("2", issues), ("3", v3)):
        SR.write_snapshot(df.drop("issue_type"), root, name, bucket, dealt=True)
    diffs = [SR.row_diff(t.spark, root, a, b, ["issue_id"]).withColumn("step", F.lit(int(b))) for a, b in (("1", "2"), ("2", "3"))]
    dash = lambda x: F.coalesce(x, F.lit("-"))
    shown = F.array_join(F.transform("changes", lambda x: F.concat(x["column"], F.lit(":"), dash(x["before"]), F.lit(">"), dash(x["after"]))), " ")
    return diffs[0].unionByName(diffs[1]).select("step", "issue_id", "change", shown.alias("changes"))


# (rule, event type, severity) of the alert stream.
ALERT_RULES = [("error-events", "error", "critical"), ("signup-events", "signup", "warning")]


@register("stream_alert_cooldown", "T3 (cooldown of 3,600 s and 7,200 s from the last alert; watermark, timers, late signals settled at read)", """
WITH RECURSIVE sig AS (
  SELECT 'error-events' AS rule, user_id AS key, ts, 3600 AS cd FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'signup-events', user_id, ts, 7200 FROM events WHERE event_type = 'signup'
), a AS (
  SELECT rule, key, min(ts) AS t, cd FROM sig WHERE ts IS NOT NULL GROUP BY rule, key, cd
  UNION ALL
  SELECT a.rule, a.key, min(s.ts), a.cd FROM a JOIN sig s ON s.rule = a.rule AND s.key = a.key AND s.ts >= a.t + to_seconds(a.cd)
  GROUP BY a.rule, a.key, a.t, a.cd
)
SELECT a.rule, a.key, a.t AS alert_ts, count(*) - 1 AS suppressed
FROM sig s ASOF JOIN a ON s.rule = a.rule AND s.key = a.key AND s.ts >= a.t GROUP BY a.rule, a.key, a.t
UNION ALL SELECT rule, key, NULL, count(*) - 1 FROM sig WHERE ts IS NULL GROUP BY rule, key""")
def q_stream_alert_cooldown(t):
    d = J.new_dirs(t.spark, "t3")
    events = J.table_stream(t.spark, t.sf_dir, "events")
    J.run_to_completion(J.cooldown_stream(t.spark, events, d["table"], d["ckpt"], ALERT_RULES))
    signals = J.rule_signals(t.table("events"), ALERT_RULES)
    return J.settled_alerts(t.spark, d["table"], signals, J.rule_cooldowns(ALERT_RULES))
