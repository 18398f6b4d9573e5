"""Queries of operators whose parameters are tables: rules as data, dictionary bitmaps, positions, the roll-up document."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import distinct_counts as DC
from defectlens.operators import rule_intervals as RI
from defectlens.operators import rules as RU
from defectlens.operators.rule_table import DEFAULT_RULES
from defectlens.plans.catalog import register
from defectlens.plans.q_rules import ALERTS_BODY, ALERTS_CTE, RECS_BODY, _devs_cte, _mods_cte, _ov_cte, kq
from defectlens.plans.report import QualityReport, process_documents, rollup_document
from defectlens.plans.sqlfrag import lst, pct, with_issue
from defectlens.session import scratch_path
from defectlens.sources import documents as D
from defectlens.sources.merge import view_sprint_rows

_DEFAULTS = ", ".join("({}, '{}', {}, '{}', '{}')".format(i, m, "NULL" if c == "default" else "'" + c + "'", t.replace("'", "''"), p)
                      for i, (m, c, t, p) in enumerate(DEFAULT_RULES) if m == "testCases")


@register("user_rules_eval", "J6 J7 R6 R7 (rules of users as a table: a pair of thresholds for each assignee and module)", with_issue(f"""
SELECT m.module, m.metric, r.text, r.priority,
  CASE r.priority WHEN 'alta' THEN '🚨' WHEN 'media' THEN '⚠️' WHEN 'baja' THEN '✅' ELSE '•' END AS icon,
  CASE WHEN contains(r.text, ':') THEN split_part(r.text, ':', 1) ELSE '' END AS emphasis
FROM metrics m JOIN ruled r ON r.metric = m.metric
WHERE (r.lo IS NULL OR m.value > r.lo) AND (r.hi IS NULL OR m.value <= r.hi)""", f"""
metrics AS (
  SELECT module, 'criticalBugs' AS metric, CAST(count_if(priority IN ({lst(C.CRITICAL_LABELS_ALL)})) AS DOUBLE) AS value FROM issue GROUP BY module
  UNION ALL SELECT module, 'testCases', CAST(sum(cases_executed) AS DOUBLE) / count(*) FROM issue GROUP BY module
), loads AS (
  SELECT coalesce(assignee, '-') AS name, count(*) AS n FROM issue GROUP BY assignee
), ruled AS (
  SELECT 'criticalBugs' AS metric, CAST(n AS DOUBLE) AS lo, CAST(2 * n AS DOUBLE) AS hi, 'Load of ' || name || ': critical' AS text,
    CASE WHEN n % 2 = 0 THEN 'alta' ELSE 'media' END AS priority FROM loads
  UNION ALL
  SELECT column1, CASE column2 WHEN 'avg >= 200' THEN 199.99999 WHEN 'avg >= 150 && avg < 200' THEN 149.99999 END,
    CASE column2 WHEN 'avg < 150' THEN 149.99999 WHEN 'avg >= 150 && avg < 200' THEN 199.99999 END, column3, column4
  FROM (VALUES {_DEFAULTS}) AS d(column0, column1, column2, column3, column4)
)"""))
def q_user_rules_eval(t):
    """Users give the critical count's rules under its old name (dropped: they also use the new one) and its new name."""
    issues = t.issues
    metrics = issues.groupBy("module").agg(
        F.count_if(F.col("priority").isin(list(C.CRITICAL_LABELS_ALL))).cast("double").alias("total"),
        (F.sum("cases_executed").cast("double") / F.count(F.lit(1))).alias("avg"))
    null = F.lit(None).cast("double")
    metrics = metrics.select("module", F.inline(F.array(
        F.struct(F.lit("criticalBugs").alias("metric"), F.col("total").alias("total"), null.alias("avg")),
        F.struct(F.lit("testCases").alias("metric"), null.alias("total"), F.col("avg").alias("avg")))))
    loads = issues.groupBy(F.coalesce("assignee", F.lit("-")).alias("name"), F.col("assignee").isNull().alias("_none")).agg(F.count(F.lit(1)).alias("n"))
    number = F.col("n").cast("string")
    user = loads.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("condition"), x.alias("text"), p.alias("priority")) for m, c, x, p in (
        ("bugsCriticosDetectados", F.concat(F.lit("total > "), number, F.lit(" && total <= "), (F.col("n") * 2).cast("string")),
         F.concat(F.lit("Load of "), "name", F.lit(": critical")), F.when(F.col("n") % 2 == 0, "alta").otherwise("media")),
        ("bugsCriticosDetectados", F.concat(F.lit("alert("), number, F.lit(")")), F.lit("outside the grammar"), F.lit("alta")),
        ("criticalBugs", F.lit("default"), F.lit("old name"), F.lit("baja")))])))
    user = RI.numbered_rules(user, first=len(DEFAULT_RULES))
    rules = RU.effective_rules(RU.rules_frame(t.spark, DEFAULT_RULES), user)
    return RI.evaluate_rule_table(metrics, rules, ["module"]).drop("rule_id")


@register("developer_counts", "A7 A22 A23 A27 S16 (distinct developers per module, environment, sprint and overall from one bitmap roll-up)", with_issue("""
SELECT 'module' AS level, module AS key, count(DISTINCT nullif(assignee, '')) AS developers, count(*) AS issues FROM issue GROUP BY module
UNION ALL SELECT 'environment', environment, count(DISTINCT nullif(assignee, '')), count(*) FROM issue GROUP BY environment
UNION ALL SELECT 'sprint', CAST(sprint_num AS VARCHAR), count(DISTINCT nullif(assignee, '')), count(*) FROM issue GROUP BY sprint_num
UNION ALL SELECT 'all', NULL, count(DISTINCT nullif(assignee, '')), count(*) FROM issue"""))
def q_developer_counts(t):
    by = ["module", "environment", "sprint_num"]
    path = scratch_path(t.spark, "bitmaps")
    DC.bitmap_rollup(t.issues, by, "assignee", DC.dictionary(t.issues, "assignee")).write.parquet(path)
    rollup, out = t.spark.read.parquet(path), None
    for level, column in (("module", "module"), ("environment", "environment"), ("sprint", "sprint_num"), ("all", None)):
        counts = DC.distinct_counts(rollup, [column] if column else [], "developers")
        key = F.col(column).cast("string") if column else F.lit(None).cast("string")
        one = counts.select(F.lit(level).alias("level"), key.alias("key"), "developers", F.col("rows").alias("issues"))
        out = one if out is None else out.unionByName(one)
    return out


@register("numbered_sprints", "N5 N6 X14 (sprint rows of a view without a number: numbered by their first issue's day)", with_issue("""
SELECT 'Sprint ' || CAST(row_number() OVER (ORDER BY first_day, label) AS VARCHAR) AS sprint,
  CAST(row_number() OVER (ORDER BY first_day, label) AS INTEGER) AS sprint_num, label, bugs
FROM (SELECT coalesce(module, '-') || '/' || environment AS label, min(created_at) AS first_day, count(*) AS bugs FROM issue GROUP BY 1)"""))
def q_numbered_sprints(t):
    view = t.issues.groupBy(F.concat(F.coalesce("module", F.lit("-")), F.lit("/"), "environment").alias("label")).agg(
        F.min("created_at").alias("first_day"), F.count(F.lit(1)).alias("bugs"))
    return view_sprint_rows(view, order_col=["first_day", "label"]).select("sprint", "sprint_num", "label", "bugs")


@register("rollup_document", "E4 A12 A13 A14 A15 A16 S11 (the dashboard's document of each environment, its sections as rows)", with_issue("""
SELECT environment, 'module' AS section, coalesce(nullif(trim(module), ''), 'Sin módulo') AS key, count(*) AS count FROM issue GROUP BY ALL
UNION ALL SELECT environment, 'category', coalesce(nullif(trim(category), ''), 'Sin categoría'), count(*) FROM issue GROUP BY ALL
UNION ALL SELECT environment, 'sprint', sprint, count(*) FROM issue GROUP BY ALL
UNION ALL SELECT environment, 'summary', 'totalBugs', count(*) FROM issue GROUP BY ALL
UNION ALL SELECT environment, 'summary', 'bugsClosed', count_if(status = 'Done') FROM issue GROUP BY ALL"""))
def q_rollup_document(t):
    """Written as JSON and read back: one document an environment, sections exploded."""
    path = scratch_path(t.spark, "rollup-document")
    rollup_document(t.issues, ["environment"]).write.json(path)
    count = "struct<count:bigint>"
    docs = t.spark.read.schema(f"environment string, summary struct<totalBugs:bigint,bugsClosed:bigint>, bugsByModule map<string,{count}>, "
                               f"bugsByCategory map<string,{count}>, sprintData array<struct<sprint:string,bugs:double>>").json(path)
    entry = lambda s, k, n: F.struct(F.lit(s).alias("section"), k.alias("key"), n.cast("long").alias("count"))
    of_map = lambda s, c: F.transform(F.map_entries(c), lambda e: entry(s, e["key"], e["value"]["count"]))
    rows = F.concat(of_map("module", "bugsByModule"), of_map("category", "bugsByCategory"),
                    F.transform("sprintData", lambda x: entry("sprint", x["sprint"], x["bugs"])),
                    F.array(*[entry("summary", F.lit(n), F.col(f"summary.{n}")) for n in ("totalBugs", "bugsClosed")]))
    return docs.select("environment", F.inline(rows))


_FIGURES = ("n_sprints total_bugs bugs_closed tc_executed critical_total avg_test_cases_per_sprint resolution_efficiency defect_density "
            "quality_index sprint_trend critical_count critical_ratio critical_pending avg_resolution_time test_execution_rate leakage_rate "
            "escape_rate rework_rate first_pass_yield burndown_efficiency avg_bugs_per_sprint consistency prediction_confidence "
            "maturity_score savings roi next_sprint_bugs quality_prediction").split()
_PEND = f"count_if(status IN ({lst(C.PENDING_STATUS_PRIORITY_VIEW)}))"


@register("report_all", "E1 (every part of the report of each environment from one cube: K1-K22 A1 A12 A13 A15 R1-R5 R8 K21-K23)", kq("environment", f"""
SELECT environment, 'kpi' AS part, unnest([{", ".join(f"'{f}'" for f in _FIGURES)}]) AS key,
  unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in _FIGURES)}]) AS value FROM kpi
UNION ALL SELECT environment, 'sprint', sprint, CAST(bugs AS DOUBLE) FROM sprint
UNION ALL SELECT environment, 'developer', assignee, CAST(pending AS DOUBLE) FROM (
  SELECT environment, assignee, {_PEND} AS pending FROM issue WHERE assignee <> '' GROUP BY environment, assignee)
UNION ALL SELECT environment, 'module', module, CAST(percentage AS DOUBLE) FROM mods
UNION ALL SELECT e.environment, 'priority', l.label, CAST(coalesce(p.pending, 0) AS DOUBLE)
  FROM (SELECT DISTINCT environment FROM issue) e CROSS JOIN (SELECT unnest([{lst(C.PRIORITY_LABELS)}]) AS label) l
  LEFT JOIN (SELECT environment, priority, {_PEND} AS pending FROM issue GROUP BY ALL) p
    ON e.environment IS NOT DISTINCT FROM p.environment AND p.priority = l.label
UNION ALL SELECT environment, 'alert', alert_id, CAST(rank AS DOUBLE) FROM alerts_ranked
UNION ALL SELECT environment, 'recommendation', rec_id, CAST(rank AS DOUBLE) FROM recs_ranked
UNION ALL SELECT environment, 'prediction', unnest(['Bugs Próximo Sprint', 'Tiempo Resolución', 'Quality Index']),
  unnest([CAST(prediction_confidence AS DOUBLE), 85.0::DOUBLE, CAST(prediction_confidence AS DOUBLE)]) FROM kpi""",
    _devs_cte("environment"), _mods_cte("environment"), _ov_cte("environment"),
    ALERTS_CTE, f"alerts_ranked AS ({ALERTS_BODY})", f"recs_ranked AS ({RECS_BODY})"))
def q_report_all(t):
    return QualityReport(t.issues, ["environment"]).all_rows()


@register("processed_documents", "V6 V5 S4 S5 S6 N1 N2 (documents of each module: whole, without a summary, cut short)", with_issue(f"""
SELECT coalesce(module, '-') AS module, kind, CASE kind WHEN 'whole' THEN total END AS total_bugs, CASE kind WHEN 'whole' THEN closed END AS bugs_closed,
  CASE kind WHEN 'whole' THEN sprints END AS n_sprints, CASE kind WHEN 'whole' THEN {pct('closed', 'total')} END AS resolution_efficiency,
  CASE kind WHEN 'whole' THEN developers END AS developers,
  CASE kind WHEN 'cut' THEN 'corrupt JSON' WHEN 'bare' THEN 'Missing summary data' END AS errors
FROM (SELECT module, count(*) AS total, count_if(status = 'Done') AS closed, count(DISTINCT sprint) AS sprints,
        count(DISTINCT nullif(assignee, '')) AS developers FROM issue GROUP BY module), (VALUES ('whole'), ('bare'), ('cut')) AS k(kind)"""))
def q_processed_documents(t):
    """A file a document; the broken ones must reach the quarantine with their reasons, the others the KPIs."""
    docs = rollup_document(t.issues, ["module"])
    parts = [c for c in docs.columns if c != "module"]
    whole, bare = F.to_json(F.struct(*parts)), F.to_json(F.struct(*[c for c in parts if c != "summary"]))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (
        ("whole", whole), ("bare", bare), ("cut", F.substring(whole, 1, 40)))])
    path = scratch_path(t.spark, "documents")
    # folder names: an empty name would be read back as null
    docs.select(F.coalesce(F.concat(F.lit("m:"), "module"), F.lit("-")).alias("module"), F.inline(kinds)).write.partitionBy("kind", "module").text(path)
    read = D.read_documents(t.spark, path, labels="kind string, module string")
    read = read.withColumn("doc_path", F.concat("kind", F.lit("/"), "module"))
    out = process_documents(read)
    developers = D.developer_rows(out["documents"]).groupBy("doc_path").agg(F.count(F.lit(1)).alias("developers"))
    good = out["kpis"].select("doc_path", "total_bugs", "bugs_closed", "n_sprints", "resolution_efficiency").join(developers, "doc_path", "left")
    bad = out["quarantine"].select("doc_path", F.array_join("errors", "; ").alias("errors"))
    every = good.unionByName(bad, allowMissingColumns=True)
    label = F.expr("substring(doc_path, instr(doc_path, '/') + 1)")
    return every.select(F.regexp_replace(label, "^m:", "").alias("module"), F.split_part("doc_path", F.lit("/"), F.lit(1)).alias("kind"),
                        *[c for c in every.columns if c != "doc_path"])
