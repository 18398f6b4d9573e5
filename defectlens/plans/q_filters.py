"""Filters, entry points and small operators; every oracle is spelled in literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens.operators import filters as FL
from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import topk as TK
from defectlens.operators.sprints import sprint_frame
from defectlens.plans import report as RP
from defectlens.plans.catalog import register
from defectlens.plans.sqlfrag import with_issue
from defectlens.sources import merge as M


@register("global_filter_counts", "F5 F6", with_issue("""
SELECT module, count(*) AS issues FROM issue
WHERE lower(trim(coalesce(status, ''))) IN ('done', 'to do', 'reopened')
  AND lower(trim(coalesce(priority, ''))) IN ('alta', 'major') AND lower(trim(environment)) IN ('prod', 'uat', 'dev')
GROUP BY module"""))
def q_global_filter(t):
    keep = FL.global_filter(status=["Done", " to do ", "REOPENED"], priority=["Alta", "Major"], developer=["All"],
                            strategy=None, environment=["PROD", "uat", "dev"])
    return t.issues.filter(keep).groupBy("module").agg(F.count(F.lit(1)).alias("issues"))


@register("test_type_counts", "N11", with_issue("""
SELECT CASE WHEN environment = 'UAT' THEN 'uat' ELSE 'system' END AS test_type, count(*) AS issues, count(DISTINCT sprint) AS sprints
FROM issue GROUP BY 1"""))
def q_test_type(t):
    return t.issues.withColumn("test_type", FL.test_type("environment")).groupBy("test_type").agg(
        F.count(F.lit(1)).alias("issues"), F.count_distinct("sprint").alias("sprints"))


@register("sprint_filter_rows", "F7 F8", with_issue("""
SELECT sprint, environment, count(*) AS issues FROM issue
WHERE sprint IN ('Sprint 3', 'Sprint 10', 'Sprint 80') AND environment = 'UAT' GROUP BY sprint, environment"""))
def q_sprint_filter(t):
    rows = t.issues.withColumn("kind", FL.test_type("environment"))
    keep = FL.sprint_filter(sprints=["sprint 3", " Sprint 10", "SPRINT 80"], version=["All"], test_type_value="UAT", test_type_col="kind")
    return rows.filter(keep).groupBy("sprint", "environment").agg(F.count(F.lit(1)).alias("issues"))


@register("sprint_row_filter_counts", "F8 (tags, strategy)", with_issue("""
SELECT environment, count(*) AS issues FROM issue
WHERE list_has_any(tags, ['blue', 'green']) AND lower(strategy) IN ('building', 'machinery') GROUP BY environment"""))
def q_sprint_row_filter(t):
    keep = FL.sprint_row_filter(tags=["Blue", " green"], strategy=["BUILDING", "machinery"], environment=["All"])
    return t.issues.filter(keep).groupBy("environment").agg(F.count(F.lit(1)).alias("issues"))


@register("sprints_for_test_type", "J3", with_issue("""
SELECT sprint, 'uat' AS test_type, count(*) AS issues FROM issue
WHERE environment = 'UAT' AND sprint IN (SELECT sprint FROM issue WHERE status = 'Reopened' AND priority = 'Major') GROUP BY sprint"""))
def q_sprints_for_test_type(t):
    rows = t.issues.withColumn("test_type", FL.test_type("environment")).groupBy("sprint", "test_type").agg(
        F.count(F.lit(1)).alias("issues"))
    labels = t.issues.filter("status = 'Reopened' AND priority = 'Major'").select("sprint")
    return M.sprints_for_test_type(rows, labels, "uat")


@register("team_analysis", "E3 (partial: label lists only) U1", with_issue("""
SELECT 'status' AS section, status AS item FROM issue GROUP BY status
UNION ALL SELECT 'issue_type', issue_type FROM issue GROUP BY issue_type
UNION ALL SELECT 'top_developer', assignee FROM (SELECT assignee FROM issue WHERE lower(issue_type) = 'bug' GROUP BY assignee
  ORDER BY count(*) DESC, assignee NULLS FIRST LIMIT 5)"""))
def q_team_analysis(t):
    parts = RP.team_analysis(t.issues)
    item = lambda section, df, c: df.select(F.lit(section).alias("section"), F.col(c).alias("item"))
    return (item("status", parts["statuses"], "status").unionByName(item("issue_type", parts["issue_types"], "issue_type"))
            .unionByName(item("top_developer", parts["top_developers"], "assignee")))


@register("verify_sources", "E5 J1 V1 V2 V3", with_issue("""
SELECT CAST(sum(a.n) AS BIGINT) AS total_a, CAST(sum(b.n) AS BIGINT) AS total_b, count(*) AS compared,
  count_if(a.n = b.n AND a.c = b.c AND a.p = b.p) AS matched
FROM (SELECT sprint_num, count(*) AS n, count_if(priority IN ('Más alta', 'Alta')) AS c, count_if(status = 'To Do') AS p FROM issue GROUP BY 1) a
JOIN (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS sprint_num, count(*) AS n,
        count_if(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS c, count_if(l_linestatus <> 'F' AND o_orderstatus NOT IN ('P', 'F')) AS p
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) b USING (sprint_num)"""))
def q_verify_sources(t):
    v = RP.verify(t.issues, t.raw_facts, F.col("priority").isin("Más alta", "Alta"), F.col("status") == "To Do",
                  F.col("is_critical"), F.col("status") == "To Do")
    return v["summary"].select("total_a", "total_b", F.col("compared").cast("long").alias("compared"),
                               F.col("matched").cast("long").alias("matched"))


@register("top2_priorities", "O10", with_issue("""
SELECT module, CAST(sum(n) AS BIGINT) AS top2 FROM (
  SELECT module, count(*) AS n, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC) AS r FROM issue GROUP BY module, priority)
WHERE r <= 2 GROUP BY module"""))
def q_top2_priorities(t):
    counts = t.issues.groupBy("module", "priority").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("module").agg(F.map_from_entries(F.collect_list(F.struct(F.col("priority"), F.col("n")))).alias("m"))
    return maps.select("module", R.top2_priority_sum(F.col("m")).alias("top2"))


@register("source_statistics", "A32", with_issue("""
SELECT module, CAST(sum(n) AS BIGINT) AS total_bugs, count(*) AS total_sprints, CAST(sum(c) AS BIGINT) AS critical_bugs, CAST(sum(p) AS BIGINT) AS pending_bugs
FROM (SELECT module, sprint, count(*) AS n, count_if(priority = 'Major') AS c, count_if(status = 'Tareas por hacer') AS p FROM issue GROUP BY module, sprint)
GROUP BY module"""))
def q_source_statistics(t):
    rows = t.issues.groupBy("module", "sprint").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("priority") == "Major").alias("critical"),
        F.count_if(F.col("status") == "Tareas por hacer").alias("pending"))
    return R.source_statistics(rows, ["module"])


@register("busy_modules", "F17 F16", with_issue("""
SELECT module, issues FROM (SELECT module, count(*) AS issues FROM issue GROUP BY module)
WHERE issues >= 400 AND module IN ('CORE', '', 'ECONOMY BRUSHED BRASS', 'PROMO PLATED TIN')"""))
def q_busy_modules(t):
    counts = t.issues.groupBy("module").agg(F.count(F.lit(1)).alias("issues"))
    return FL.visible_metrics(FL.having(counts, "issues", 400, ">="), ["CORE", "", "ECONOMY BRUSHED BRASS", "PROMO PLATED TIN"], "module")


@register("resolution_percentiles", "K37", with_issue("""
SELECT module, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90
FROM (SELECT module, datediff('day', created_at, resolved_at)::DOUBLE AS d FROM issue) WHERE d > 0 GROUP BY module"""))
def q_resolution_percentiles(t):
    return K.resolution_percentiles(t.issues, ["module"])


@register("sprints_by_suffix", "O5", with_issue("""
SELECT sprint, count(*) AS issues, TRY_CAST(trim(right(sprint, 2)) AS INTEGER) AS suffix FROM issue GROUP BY sprint"""))
def q_sprints_by_suffix(t):
    counts = t.issues.groupBy("sprint").agg(F.count(F.lit(1)).alias("issues"))
    return TK.sprints_by_suffix(counts).withColumn("suffix", F.trim(F.substring("sprint", -2, 2)).try_cast("int"))


@register("default_record", "N8", with_issue("""
SELECT environment, count(*) AS issues FROM issue WHERE status = 'Reopened' GROUP BY environment
UNION ALL SELECT 'none', 0 WHERE NOT EXISTS (SELECT 1 FROM issue WHERE status = 'no such status')"""))
def q_default_record(t):
    counts = lambda status: (t.issues.filter(F.col("status") == status).groupBy("environment")
                             .agg(F.count(F.lit(1)).alias("issues")))
    # an all-zero record, made from the table itself: one row whatever the table holds
    zero = t.issues.agg((F.count(F.lit(1)) * 0).alias("issues")).select(F.lit("none").alias("environment"), "issues")
    return M.default_if_empty(counts("Reopened"), zero).unionByName(M.default_if_empty(counts("no such status"), zero))


@register("cycle_time_real", "K24 (mean of the sprints' real resolution times)", with_issue("""
SELECT module, greatest(coalesce(floor(avg(a) + 0.5), 14.0), 1.0)::DOUBLE AS cycle_time
FROM (SELECT module, sprint, avg(CASE WHEN d > 0 THEN d END) AS a
      FROM (SELECT module, sprint, datediff('day', created_at, resolved_at) AS d FROM issue) GROUP BY module, sprint)
GROUP BY module HAVING count(a) > 0"""))
def q_cycle_time_real(t):
    days = F.datediff("resolved_at", "created_at")
    real = t.issues.groupBy("module", "sprint").agg(F.avg(F.when(days > 0, days)).alias("avg_resolution_time"))
    sprints = R.join_null_safe(sprint_frame(t.issues, ["module"]), real, ["module", "sprint"])
    out = K.cycle_time(sprints, R.priority_breakdown(t.issues, ["module"]), ["module"])
    known = real.filter("avg_resolution_time IS NOT NULL").select("module").distinct()
    return R.join_null_safe(out, known.withColumn("known", F.lit(True)), ["module"]).filter("known").select("module", "cycle_time")
