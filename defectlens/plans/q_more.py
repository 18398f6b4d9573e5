"""Legacy KPI record, team / module findings, legacy alerts, team overview
and source precedence queries (K5 K33 K36 K38, R17-R19, A22 A23, J9 U7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.functions import pct as col_pct
from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import rules as RU
from defectlens.operators.cube import RollupCube
from defectlens.operators.sprints import sprint_frame
from defectlens.plans.catalog import register
from defectlens.plans.q_kpis import inputs_cte, sprint_cte
from defectlens.plans.sqlfrag import f2, jr, lst, pct, truthy_or, with_issue
from defectlens.sources.merge import fallback, union_by_priority

PEND2 = lst(C.PENDING_STATUS_PRIORITY_VIEW)
CLOSED = lst(C.CLOSED_STATUS_SQL)


@register("team_overview", "A22 A23 (by module)", with_issue(f"""
SELECT module, total, developers, assigned, pending, {pct('assigned - pending', 'assigned')} AS efficiency,
  CAST(greatest(0, total - assigned) AS BIGINT) AS unassigned
FROM (SELECT module, count(*) AS total,
        count(DISTINCT CASE WHEN assignee IS NOT NULL AND assignee <> '' THEN assignee END) AS developers,
        count_if(assignee IS NOT NULL AND assignee <> '') AS assigned,
        count_if(assignee IS NOT NULL AND assignee <> '' AND status IN ({PEND2})) AS pending
      FROM issue GROUP BY module)"""))
def q_team_overview(t):
    return R.team_overview(t.issues, ["module"])


def _legacy_sql():
    w = C.DEFAULT_WEIGHTS
    tct = truthy_or("tc_total", "1")
    rr = "(CASE WHEN total_bugs > 0 THEN bugs_closed / total_bugs * 100 ELSE 100.0::DOUBLE END)"
    dens = ("(CASE WHEN tc_executed > 0 THEN greatest(0.0::DOUBLE, 100 - total_bugs / tc_executed * 50) "
            "ELSE 100.0::DOUBLE END)")
    cs = "(CASE WHEN total_bugs > 0 THEN greatest(0.0::DOUBLE, 100 - crit_cfg / total_bugs * 100) ELSE 100.0::DOUBLE END)"
    qi = (f"{rr} * {w['resolutionRate']}::DOUBLE + (tc_executed / {tct} * 100) * {w['testCoverage']}::DOUBLE "
          f"+ {dens} * {w['bugDensity']}::DOUBLE + {cs} * {w['criticalBugs']}::DOUBLE")
    trend = ("(CASE WHEN n < 2 OR first_bugs IS NULL OR first_bugs = 0 THEN CAST(0 AS BIGINT) "
             f"ELSE {jr('(last_bugs - first_bugs) / first_bugs * 100')} END)")
    return with_issue(f"""
SELECT module, {jr(f'tc_executed / {tct} * 100')} AS test_coverage, {pct('bugs_closed', 'total_bugs')} AS resolution_efficiency,
  {jr(qi)} AS quality_index_legacy, {trend} AS sprint_trend,
  CASE WHEN tc_executed > 0 THEN {f2('total_bugs / tc_executed')} ELSE 0.0::DOUBLE END AS defect_density,
  {pct('crit_cfg', 'total_bugs')} AS critical_ratio,
  CASE WHEN bugs_closed > 0 THEN {f2('rework_bugs / bugs_closed * 100')} ELSE 0.0::DOUBLE END AS regression_rate,
  {jr('crit_cfg * 0.4::DOUBLE')} AS critical_top, {jr('crit_cfg * 0.6::DOUBLE')} AS critical_high
FROM inp""", sprint_cte(["module"]), inputs_cte(["module"]))


@register("legacy_kpis", "K5 K33 K36 K38 (by module)", _legacy_sql())
def q_legacy_kpis(t):
    by = ["module"]
    return K.legacy_kpis(K.kpi_inputs(sprint_frame(t.issues, by), by), by)


_DEVS_ENV = f"""devs AS (SELECT environment, assignee, assigned, assigned - pending AS resolved, pending,
  CASE WHEN assigned > 20 THEN 'Alto' WHEN assigned > 10 THEN 'Medio' ELSE 'Bajo' END AS workload
  FROM (SELECT environment, assignee, count(*) AS assigned, count_if(status IN ({PEND2})) AS pending FROM issue
        WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY environment, assignee))"""


@register("team_findings", "R17 O9 K29 (by environment)", with_issue(f"""
SELECT g.environment, low_load_developers, overall_efficiency, top_assignee, top_pending,
  coalesce(top_pending > 15, false) AS overloaded
FROM (SELECT environment, count_if(contains(lower(coalesce(workload, '')), 'bajo')) AS low_load_developers,
        {pct('sum(resolved)', 'sum(assigned)')} AS overall_efficiency FROM devs GROUP BY environment) g
LEFT JOIN (SELECT environment, assignee AS top_assignee, pending AS top_pending FROM
           (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY pending DESC, assignee ASC) AS rn FROM devs)
           WHERE rn = 1) t ON g.environment = t.environment""", _DEVS_ENV))
def q_team_findings(t):
    by = ["environment"]
    devs = RollupCube(t.issues, by).developers().select("environment", "assignee", "assigned", "resolved", "pending", "workload")
    return RU.team_findings(devs, by)


_MODS_ENV = f"""mods AS (SELECT environment, module, total, resolved,
  {pct('total', 'sum(total) OVER (PARTITION BY environment)')} AS percentage
  FROM (SELECT environment, module, count(*) AS total, count_if(status IN ({CLOSED})) AS resolved FROM issue
        GROUP BY environment, module))"""


def _mods_env(t):
    g = t.issues.groupBy("environment", "module").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(C.CLOSED_STATUS_SQL)).alias("resolved"))
    return R.with_group_total(g, "total", ["environment"], "_t").withColumn(
        "percentage", col_pct(F.col("total"), F.col("_t"))).drop("_t")


@register("module_findings", "R18 X8 (by environment)", with_issue(f"""
SELECT g.environment, modules, high_resolution_modules, critical_module, critical_percentage
FROM (SELECT environment, count(*) AS modules,
        coalesce(string_agg(CASE WHEN total > 0 AND resolved / total >= 0.8 THEN module END, ', ' ORDER BY module), '')
          AS high_resolution_modules FROM mods GROUP BY environment) g
LEFT JOIN (SELECT environment, module AS critical_module, percentage AS critical_percentage FROM
           (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY percentage DESC, module ASC) AS rn
            FROM mods WHERE percentage >= 60) WHERE rn = 1) c ON g.environment = c.environment""", _MODS_ENV))
def q_module_findings(t):
    return RU.module_findings(_mods_env(t), ["environment"])


@register("legacy_alerts", "R19 (by environment; named module STANDARD)", with_issue(f"""
SELECT environment, 'critical' AS type, 'Bugs Críticos Elevados' AS title,
  concat(CAST(v AS VARCHAR), ' bugs críticos pendientes requieren atención inmediata') AS message
FROM (SELECT environment, CAST(sum(p) AS BIGINT) AS v FROM (SELECT environment, priority, count_if(status IN ({PEND2})) AS p
      FROM issue WHERE priority IN ('Más alta', 'Alta') GROUP BY environment, priority) GROUP BY environment) WHERE v > 20
UNION ALL SELECT environment, 'warning', 'Concentración de Bugs', concat(assignee, ' tiene ', CAST(pending AS VARCHAR),
  ' bugs pendientes') FROM (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY pending DESC, assignee ASC) AS rn
  FROM devs) WHERE rn = 1 AND pending > 15
UNION ALL SELECT environment, 'warning', 'Módulo STANDARD Crítico', concat('El módulo STANDARD concentra ',
  CAST(percentage AS VARCHAR), '% de los bugs') FROM mods WHERE module = 'STANDARD' AND percentage > 60""",
    _DEVS_ENV, _MODS_ENV))
def q_legacy_alerts(t):
    by = ["environment"]
    cube = RollupCube(t.issues, by)
    return RU.legacy_alerts(cube.priorities(), cube.pending(), cube.modules(), by, module_label="STANDARD")


@register("sprint_source_priority", "U7 J9 (bug roll-up, else task roll-up, else all issues)", with_issue("""
SELECT module, sprint, total, source FROM (
  SELECT *, row_number() OVER (PARTITION BY module, sprint ORDER BY r) AS rn FROM (
    SELECT module, sprint, count(*) AS total, 'bugs' AS source, 0 AS r FROM issue WHERE issue_type = 'Bug'
      GROUP BY module, sprint
    UNION ALL SELECT module, sprint, count(*), 'tasks', 1 FROM issue WHERE issue_type = 'Tarea' GROUP BY module, sprint
    UNION ALL SELECT module, sprint, count(*), 'all', 2 FROM issue GROUP BY module, sprint))
WHERE rn = 1"""))
def q_sprint_source_priority(t):
    iss = t.issues
    per = lambda df: df.groupBy("module", "sprint").agg(F.count(F.lit(1)).alias("total"))
    return union_by_priority([("bugs", per(iss.filter(F.col("issue_type") == "Bug"))),
                              ("tasks", per(iss.filter(F.col("issue_type") == "Tarea"))),
                              ("all", per(iss))], ["module", "sprint"])


@register("sprint_fallback", "J9 (suggestion roll-up where present, else derived from all issues)", with_issue("""
SELECT module, sprint, total FROM (SELECT module, sprint, count(*) AS total FROM issue WHERE issue_type = 'Sugerencia'
  GROUP BY module, sprint) p
UNION ALL SELECT a.module, a.sprint, a.total FROM (SELECT module, sprint, count(*) AS total FROM issue
  GROUP BY module, sprint) a
WHERE NOT EXISTS (SELECT 1 FROM issue i WHERE i.issue_type = 'Sugerencia' AND i.module = a.module AND i.sprint = a.sprint)"""))
def q_sprint_fallback(t):
    iss = t.issues
    per = lambda df: df.groupBy("module", "sprint").agg(F.count(F.lit(1)).alias("total"))
    return fallback(per(iss.filter(F.col("issue_type") == "Sugerencia")), per(iss), ["module", "sprint"])


@register("roi_by_module", "K20 X10 (savings with thousands separators)", with_issue(f"""
SELECT module, CAST(total_bugs * 4500 AS BIGINT) AS savings, format('{{:,}}', CAST(total_bugs * 4500 AS BIGINT))
  AS early_detection, CASE WHEN total_bugs > 0 THEN {jr('total_bugs * 4500 / (total_bugs * 500) * 100')} END AS roi
FROM (SELECT module, count(*) AS total_bugs FROM issue GROUP BY module)"""))
def q_roi_by_module(t):
    by = ["module"]
    return K.roi_text(K.kpis(sprint_frame(t.issues, by), by), by)


def _initials_sql(c: str) -> str:
    return (f"substring(array_to_string(list_transform(list_filter(regexp_split_to_array(trim({c}), '\\s+'), "
            f"lambda x: x <> ''), lambda x: left(x, 1)), ''), 1, 2)")


@register("developer_bands", "R12 N13 N14 (developers derived from issues)", with_issue(f"""
SELECT assignee, {_initials_sql('assignee')} AS initials, efficiency, pending,
  CASE WHEN efficiency >= 80 THEN 'high' WHEN efficiency >= 60 THEN 'medium' ELSE 'low' END AS efficiency_band,
  CASE WHEN pending > 15 THEN 'overloaded' WHEN pending > 10 THEN 'busy' ELSE 'normal' END AS pending_band
FROM (SELECT assignee, {pct('resolved', 'total')} AS efficiency, total - resolved AS pending
      FROM (SELECT coalesce(nullif(trim(assignee), ''), 'Sin asignar') AS assignee, count(*) AS total,
              count_if(""" + " OR ".join(f"contains(lower(coalesce(status, '')), '{w}')"
                                         for w in C.CLOSED_STATUS_KEYWORDS) + """) AS resolved
            FROM issue WHERE lower(issue_type) = 'bug' GROUP BY 1))"""))
def q_developer_bands(t):
    from defectlens.functions.text import initials
    devs = R.developers_from_issues(t.issues)
    return RU.developer_bands(devs).withColumn("initials", initials("assignee"))


@register("first_sprints", "O13 (first 12 sprints by number: a sample feature)", with_issue("""
SELECT sprint, sprint_num, bugs FROM (SELECT sprint, sprint_num, count(*) AS bugs FROM issue GROUP BY sprint, sprint_num)
ORDER BY sprint_num, sprint LIMIT 12"""))
def q_first_sprints(t):
    from defectlens.operators.topk import first_n_sprints
    sp = t.issues.groupBy("sprint", "sprint_num").agg(F.count(F.lit(1)).alias("bugs"))
    return first_n_sprints(sp, 12)
