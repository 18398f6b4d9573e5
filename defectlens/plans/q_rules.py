"""Alert, recommendation, band and rule-table queries (R*, K32, K34, A31, A34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators import rules as RU
from defectlens.operators.cube import RollupCube
from defectlens.operators.rule_table import DEFAULT_ICON, DEFAULT_RULES, PRIORITY_ICONS
from defectlens.operators.sprints import sprint_frame
from defectlens.plans.catalog import register
from defectlens.plans.q_kpis import cycle_cte, inputs_cte, kpi_cte, sprint_cte
from defectlens.plans.sqlfrag import f2, jr, lst, pct, truthy_or, with_issue

PEND2 = lst(C.PENDING_STATUS_PRIORITY_VIEW)
TH = C.DEFAULT_THRESHOLDS


def kq(by: str, body: str, *extra: str) -> str:
    return with_issue(body, sprint_cte([by]), inputs_cte([by]), kpi_cte([by]), *extra)


def _devs_cte(by):
    return (f"devs AS (SELECT {by}, assignee, count_if(status IN ({PEND2})) AS pending FROM issue "
            f"WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY {by}, assignee)")


def _mods_cte(by):
    return (f"mods AS (SELECT {by}, module, count, {pct('count', f'sum(count) OVER (PARTITION BY {by})')} AS percentage "
            f"FROM (SELECT {by}, coalesce(nullif(trim(module), ''), '{C.DEFAULT_MODULE_LABEL}') AS module, "
            f"count(*) AS count FROM issue GROUP BY ALL))")


def _ov_cte(by):
    return (f"ov AS (SELECT {by}, assignee AS overloaded_assignee FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {by} ORDER BY pending DESC, assignee ASC) AS rn FROM devs "
            f"WHERE pending > {TH['maxBugsDeveloper']}) WHERE rn = 1)")


def _alerts_sql(by="environment"):
    head = f"SELECT {by}, "
    body = f"""
WITH_ALERTS AS (
{head}'critical-bugs-high' AS alert_id, 'critical' AS type, 'High Critical Bugs' AS title,
  concat(CAST(critical_pending AS VARCHAR), ' pending critical bugs require immediate attention') AS message,
  'Review and prioritize resolution' AS action, 1 AS priority, 'quality-control' AS area
  FROM kpi WHERE critical_pending > {TH['criticalBugsAlert']}
UNION ALL {head}'low-test-coverage', 'warning', 'Low Test Coverage',
  concat('Test coverage is ', CAST(test_execution_rate AS VARCHAR), '%, below minimum required ({TH['minTestCoverage']}%)'),
  'Increase test cases and automation', 2, 'test-coverage' FROM kpi WHERE test_execution_rate < {TH['minTestCoverage']}
UNION ALL {head}'negative-trend', 'warning', 'Negative Bug Trend',
  concat('Bugs have increased ', CAST(sprint_trend AS VARCHAR), '% in recent sprints'),
  'Review development and testing process', 3, 'process-improvement' FROM kpi WHERE sprint_trend > {TH['maxBugTrendIncrease']}
UNION ALL {head}'developer-overload', 'warning', 'Bug Concentration',
  concat(assignee, ' has ', CAST(pending AS VARCHAR), ' pending bugs'), 'Consider load redistribution', 2, 'team-management'
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY pending DESC, assignee ASC) AS rn FROM devs
        WHERE pending > {TH['maxBugsDeveloper']}) WHERE rn = 1
UNION ALL {head}concat('module-critical-', module), 'warning', concat(module, ' Module Critical'),
  concat('Module ', module, ' concentrates ', CAST(percentage AS VARCHAR), '% of bugs'),
  concat('Plan refactoring of ', module, ' module'), 2, 'architecture'
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY percentage DESC, module ASC) AS rn FROM mods
        WHERE percentage > {TH['criticalModulePercentage']}) WHERE rn = 1)"""
    return body


def _alerts_frames(t, by):
    cube = RollupCube(t.issues, [by])
    return K.kpis(cube.sprints(), [by]), cube.pending(), cube.modules().select(by, "module", "percentage")


ALERTS_CTE = "alerts_all AS (SELECT * FROM (" + _alerts_sql().replace("WITH_ALERTS AS (", "", 1).rstrip()[:-1] + "))"
ALERTS_BODY = """
SELECT *, CAST(row_number() OVER (PARTITION BY environment ORDER BY priority, CASE WHEN alert_id = 'developer-overload' THEN 1 WHEN alert_id LIKE 'module-critical-%' THEN 2 ELSE 3 END) AS INTEGER) AS rank,
  row_number() OVER (PARTITION BY environment ORDER BY priority, CASE WHEN alert_id = 'developer-overload' THEN 1 WHEN alert_id LIKE 'module-critical-%' THEN 2 ELSE 3 END) <= 3 AS shown,
  greatest(count(*) OVER (PARTITION BY environment) - 3, 0) AS overflow
FROM alerts_all"""


@register("alerts_by_environment", "R1-R5 O6 O9 K8 K10 W1", kq("environment", ALERTS_BODY, _devs_cte("environment"), _mods_cte("environment"), ALERTS_CTE))
def q_alerts_by_environment(t):
    kpi, devs, mods = _alerts_frames(t, "environment")
    return RU.alerts(kpi, devs, mods, ["environment"])


@register("alerts_by_type", "A34 over R1-R5", kq("environment", """
SELECT environment, type, count(*) AS alerts FROM alerts_all GROUP BY environment, type""",
    _devs_cte("environment"), _mods_cte("environment"), ALERTS_CTE))
def q_alerts_by_type(t):
    kpi, devs, mods = _alerts_frames(t, "environment")
    return RU.alerts_by_type(RU.alerts(kpi, devs, mods, ["environment"]), ["environment"])


def _recs_body(by="environment"):
    dens = f"total_bugs / {truthy_or('tc_executed', '1')}"
    rows = [
        (1, "improve-test-coverage", "quality", "Improve Test Coverage", "high", "medium", 14, "testing",
         f"test_execution_rate < {TH['minTestCoverage']}"),
        (2, "address-bug-trend", "process", "Address Bug Trend", "high", "high", 30, "process-improvement",
         f"sprint_trend > {TH['maxBugTrendIncrease']}"),
        (3, "reduce-defect-density", "quality", "Reduce Defect Density", "medium", "medium", 21, "code-quality",
         f"{dens} > {TH['maxDefectDensity']}::DOUBLE"),
        (4, "increase-automation", "efficiency", "Increase Automation", "high", "high", 45, "automation", "0.0 < 60"),
        (5, "balance-workload", "team", "Balance Workload", "medium", "low", 3, "team-management",
         "overloaded_assignee IS NOT NULL"),
    ]
    parts = [f"SELECT k.{by}, {i} AS seq, '{rid}' AS rec_id, '{typ}' AS type, '{title}' AS title, '{imp}' AS impact, "
             f"'{eff}' AS effort, {days} AS estimated_days, '{cat}' AS category FROM kpi k LEFT JOIN ov ON k.{by} IS NOT DISTINCT FROM ov.{by} "
             f"WHERE {cond}" for i, rid, typ, title, imp, eff, days, cat, cond in rows]
    return f"""
SELECT {by}, rec_id, type, title, impact, effort, estimated_days, category,
  CAST(row_number() OVER (PARTITION BY {by} ORDER BY CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
                         seq) AS INTEGER) AS rank
FROM ({" UNION ALL ".join(parts)})"""


RECS_BODY = _recs_body()


@register("recommendations_by_environment", "R8 O7 O9", kq("environment", RECS_BODY, _devs_cte("environment"), _ov_cte("environment")))
def q_recommendations(t):
    iss = t.issues
    by = ["environment"]
    kpi = K.kpis(sprint_frame(iss, by), by)
    devs = R.assignee_pending(iss, by)
    ov = RU.first_over(devs.filter(F.col("pending") > TH["maxBugsDeveloper"]), by,
                       [F.desc("pending"), F.asc("assignee")]).select("environment",
                                                                      F.col("assignee").alias("overloaded_assignee"))
    return RU.recommendations(kpi, ov, by)


def _actionable_sql():
    ai = f"""ai AS (SELECT module,
  CASE WHEN total > 0 THEN {jr('closed / total * 100')} ELSE CAST(0 AS BIGINT) END AS resolution_efficiency,
  CASE WHEN n > 0 THEN {jr('tcases / n')} ELSE CAST(0 AS BIGINT) END AS avg_test_cases,
  CASE WHEN total > 0 THEN crit / total * 100 ELSE 0.0::DOUBLE END AS critical_pct,
  {jr(f"{float(C.SPRINT_DAYS)}::DOUBLE * (1 - eff_sum / {truthy_or('n', '1')} * 0.5::DOUBLE)")} AS cycle_time,
  total / {truthy_or('n * 6', '1')} AS defects_per_unit
FROM (SELECT module, count(*) AS n, CAST(sum(bugs) AS BIGINT) AS total, CAST(sum(bugs_resolved) AS BIGINT) AS closed,
        CAST(sum(test_cases) AS BIGINT) AS tcases,
        CAST(sum(coalesce(nullif(c_mas_alta, 0), nullif(c_alta, 0), 0)) AS BIGINT) AS crit,
        sum(CASE WHEN bugs > 0 THEN bugs_resolved / bugs ELSE 0.0::DOUBLE END) AS eff_sum
      FROM sprint GROUP BY module))"""
    eff, dens, ct, cp, tc = "resolution_efficiency", "defects_per_unit", "cycle_time", "critical_pct", "avg_test_cases"
    rows = [
        (1, "velocity", "high", "Reduce Critical Cycle Time", "High", "Medium", ct, f"{ct} > 10"),
        (2, "velocity", "medium", "Optimize Resolution Velocity", "Medium", "Low", ct, f"{ct} <= 10 AND {ct} > 7"),
        (3, "quality", "high", "Urgent Code Quality Improvement", "Very High", "High", f2(dens), f"{dens} > 2.0::DOUBLE"),
        (4, "quality", "medium", "Strengthen Quality Practices", "Medium", "Medium", f2(dens),
         f"{dens} <= 2.0::DOUBLE AND {dens} > 1.0::DOUBLE"),
        (5, "efficiency", "high", "Improve Critical Resolution Efficiency", "Critical", "High", eff, f"{eff} < 50"),
        (6, "efficiency", "medium", "Increase Resolution Rate", "High", "Medium", eff, f"{eff} >= 50 AND {eff} < 70"),
        (7, "critical", "high", "High Volume of Critical Bugs", "Very High", "High", cp, f"{cp} > 30"),
        (8, "critical", "medium", "Reduce Proportion of Critical Bugs", "High", "Medium", cp, f"{cp} <= 30 AND {cp} > 20"),
        (9, "testing", "medium", "Increase Test Coverage", "High", "High", tc, f"{tc} < 150"),
        (10, "excellence", "low", "Excellent Performance - Maintain Practices", "Medium", "Low", eff,
         f"{eff} >= 80 AND {dens} <= 1.0::DOUBLE AND {ct} <= 7"),
    ]
    parts = [f"SELECT module, {i} AS seq, '{cat}' AS category, '{pr}' AS priority, '{title}' AS title, "
             f"'{imp}' AS impact, '{eff_}' AS effort, CAST({val} AS DOUBLE) AS value FROM ai WHERE {cond}"
             for i, cat, pr, title, imp, eff_, val, cond in rows]
    return with_issue(f"""
SELECT module, category, priority, title, impact, effort, value,
  CAST(row_number() OVER (PARTITION BY module ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
                         seq) AS INTEGER) AS rank
FROM ({" UNION ALL ".join(parts)})""", sprint_cte(["module"]), ai)


@register("actionable_recommendations", "R16 K26 K27 O8", _actionable_sql())
def q_actionable(t):
    by = ["module"]
    return RU.actionable_recommendations(RU.actionable_inputs(sprint_frame(t.issues, by), by), by)


def _horizon_sql():
    inner = _actionable_sql()
    return (inner.replace("\nSELECT module, category, priority, title, impact, effort, value,",
                          ", rec AS (\nSELECT module, category, priority, title, impact, effort, value,", 1)
            + """)
SELECT module, category, count(*) AS recommendations, string_agg(title, ' | ' ORDER BY rank) AS titles
FROM rec GROUP BY module, category""")


@register("recommendations_by_horizon", "A31 over R16", _horizon_sql())
def q_recommendations_by_horizon(t):
    by = ["module"]
    recs = RU.actionable_recommendations(RU.actionable_inputs(sprint_frame(t.issues, by), by), by)
    return RU.recommendations_by_horizon(recs, by)


def _cards_sql():
    dens = f"CASE WHEN tc_executed > 0 THEN {f2('total_bugs / tc_executed')} END"
    vals = {"defectDensity": dens, "testEfficiency": "CAST(test_execution_rate AS DOUBLE)",
            "bugLeakage": "CAST(leakage_rate AS DOUBLE)", "testAutomation": "CAST(NULL AS DOUBLE)",
            "codeCoverage": "CAST(NULL AS DOUBLE)", "cycleTime": "CAST(avg_resolution_time AS DOUBLE)"}
    parts = []
    for key, target, hb, good, warn in RU.METRIC_CARDS:
        v = f"({vals[key]})"
        op = ">=" if hb else "<="
        status = (f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} {op} {float(good)}::DOUBLE THEN 'success' "
                  f"WHEN {v} {op} {float(warn)}::DOUBLE THEN 'warning' ELSE 'danger' END")
        r = f"({v} / {target})" if hb else f"(CASE WHEN {v} > 0 THEN {float(target)}::DOUBLE / {v} ELSE 1.0::DOUBLE END)"
        prog = f"CASE WHEN {v} IS NULL THEN NULL ELSE {jr(f'least(greatest({r} * 100, 0.0::DOUBLE), 100.0::DOUBLE)')} END"
        parts.append(f"SELECT module, '{key}' AS metric, {v} AS value, {float(target)}::DOUBLE AS target, "
                     f"{status} AS status, CAST({prog} AS BIGINT) AS progress FROM kpi")
    return kq("module", " UNION ALL ".join(parts))


@register("metric_cards", "K34 R9 K32", _cards_sql())
def q_metric_cards(t):
    by = ["module"]
    return RU.metric_cards(K.kpis(sprint_frame(t.issues, by), by), by)


@register("overview_bands", "R10 R12 R14", kq("module", """
SELECT module,
  CASE WHEN avg_test_cases_per_sprint >= 170 THEN 'success' ELSE 'warning' END AS cases_band,
  CASE WHEN defect_density * 100 <= 20 THEN 'success' WHEN defect_density * 100 <= 30 THEN 'warning' ELSE 'danger' END
    AS density_band,
  CASE WHEN test_execution_rate >= 95 THEN 'success' WHEN test_execution_rate >= 80 THEN 'warning' ELSE 'danger' END
    AS execution_band,
  CASE WHEN critical_ratio <= 20 THEN 'success' ELSE 'danger' END AS critical_band,
  CASE WHEN critical_pending <= 10 THEN 'success' ELSE 'danger' END AS pending_band,
  CASE WHEN resolution_efficiency >= 70 THEN 'success' ELSE 'warning' END AS efficiency_band,
  CASE WHEN resolution_efficiency >= 80 THEN 'Alta' WHEN resolution_efficiency >= 60 THEN 'Media' ELSE 'Baja' END
    AS efficiency_level,
  CASE WHEN leakage_rate <= 2 THEN 'Excelente' WHEN leakage_rate <= 5 THEN 'Aceptable' ELSE 'Crítico' END AS leakage_level,
  CASE WHEN test_execution_rate >= 95 THEN 'Excelente' WHEN test_execution_rate >= 80 THEN 'Bueno' ELSE 'Crítico' END
    AS execution_level
FROM kpi"""))
def q_overview_bands(t):
    by = ["module"]
    return RU.overview_bands(K.kpis(sprint_frame(t.issues, by), by), by)


@register("module_risk_bands", "R11 A13", with_issue(f"""
SELECT module, count, percentage,
  CASE WHEN percentage >= 60 THEN 'Alto' WHEN percentage >= 40 THEN 'Medio' ELSE 'Bajo' END AS risk
FROM (SELECT module, count, {pct('count', 'sum(count) OVER ()')} AS percentage
      FROM (SELECT coalesce(nullif(trim(module), ''), '{C.DEFAULT_MODULE_LABEL}') AS module, count(*) AS count
            FROM issue GROUP BY 1))"""))
def q_module_risk_bands(t):
    m = R.module_breakdown(t.issues)
    return m.select("module", "count", "percentage", RU.module_risk(F.col("percentage")).alias("risk"))


# ---------------------------------------------------------------- R6 in SQL

def _cond_sql(text: str, avail: set[str]) -> str:
    try:
        atoms = RU.parse_condition(text)
    except RU.RuleError:
        return "false"
    if atoms is None:
        return "true"
    out = []
    for field, op, num in atoms:
        col = RU.field_column(field)
        if col not in avail:
            return "false"
        out.append(f"{col} {'=' if op == '==' else op} {num}::DOUBLE")
    return "coalesce(" + " AND ".join(out) + ", false)"


_FIELDS = ["avg", "efficiency", "total", "pending", "byPriority__critical", "critical"]


def _rules_sql():
    def row(metric, **f):
        return ("SELECT k.module, '" + metric + "' AS metric, " +
                ", ".join(f"CAST({f.get(n, 'NULL')} AS DOUBLE) AS {n}" for n in _FIELDS) +
                " FROM kpi k LEFT JOIN cyc ON k.module IS NOT DISTINCT FROM cyc.module")
    crit_share = "CASE WHEN total_bugs > 0 THEN critical_total / total_bugs ELSE 0.0::DOUBLE END"
    metrics = " UNION ALL ".join([
        row("testCases", avg="avg_test_cases_per_sprint"),
        row("resolutionEfficiency", efficiency="resolution_efficiency"),
        row("criticalBugs", total="critical_total"),
        row("criticalBugsStatus", pending="critical_pending"),
        row("cycleTime", avg="cycle_time", byPriority__critical="critical_days"),
        row("defectDensity", avg="defect_density", critical=crit_share),
    ])
    avail = set(_FIELDS) | {"module", "metric"}
    vals = ", ".join("(" + str(i) + ", '" + m + "', '" + t.replace("'", "''") + "', '" + p + "')"
                     for i, (m, _c, t, p) in enumerate(DEFAULT_RULES))
    case = "CASE " + " ".join(f"WHEN rule_id = {i} THEN {_cond_sql(c, avail)}"
                              for i, (_m, c, _t, _p) in enumerate(DEFAULT_RULES)) + " ELSE false END"
    icon = "CASE lower(priority) " + " ".join(f"WHEN '{p}' THEN '{ic}'" for p, ic in PRIORITY_ICONS.items()) + \
        f" ELSE '{DEFAULT_ICON}' END"
    return kq("module", f"""
SELECT m.module, m.metric, CAST(r.rule_id AS INTEGER) AS rule_id, r.text, coalesce(r.priority, 'media') AS priority,
  {icon} AS icon, CASE WHEN contains(r.text, ':') THEN split_part(r.text, ':', 1) ELSE '' END AS emphasis
FROM ({metrics}) m JOIN (VALUES {vals}) AS r(rule_id, metric, text, priority) ON m.metric = r.metric
WHERE {case}""", cycle_cte("module"))


@register("rule_table_eval", "R6 J6 R7 K24 K25 (compiled rule text)", _rules_sql())
def q_rule_table_eval(t):
    by = ["module"]
    cube = RollupCube(t.issues, by)
    kpi = K.kpis(cube.sprints(), by)
    cyc = K.cycle_time(cube.sprints(), cube.priorities(), by).select("module", "cycle_time", "critical_days")
    return RU.evaluate_rules(RU.metric_fields(kpi, cyc, by), DEFAULT_RULES, by)


_AREAS = ["STANDARD", "PROMO", "POS"]


@register("risk_areas", "R20 J5", with_issue(" UNION ALL ".join(
    f"SELECT '{a}' AS area, count_if(module = '{a}') AS bugs, 'Crítico' AS impact FROM issue" for a in _AREAS)))
def q_risk_areas(t):
    return RU.risk_areas(t.issues, _AREAS)


_MODCFG = {"modules": {"STANDARD": {"weight": 0.3, "criticalThreshold": 15},
                       "PROMO": {"weight": 0.2, "criticalThreshold": 20}}}


def _thresholds_sql():
    cfg = C.Config.from_dict(_MODCFG)
    vals = ", ".join(f"('{k}', {float(v['weight'])}::DOUBLE, {float(v['criticalThreshold'])}::DOUBLE)"
                     for k, v in cfg.modules.items())
    return with_issue(f"""
SELECT m.module, m.count, m.pending, m.percentage, coalesce(d.weight, 0.0::DOUBLE) AS weight,
  coalesce(d.critical_threshold, 100.0::DOUBLE) AS critical_threshold,
  m.percentage > coalesce(d.critical_threshold, 100.0::DOUBLE) AS over_threshold
FROM (SELECT key AS module, count, pending, {pct('count', 'sum(count) OVER ()')} AS percentage FROM
      (SELECT coalesce(nullif(trim(module), ''), '{C.DEFAULT_MODULE_LABEL}') AS key, count(*) AS count,
              count_if(status IN ({PEND2})) AS pending FROM issue GROUP BY 1)) m
LEFT JOIN (VALUES {vals}) AS d(module, weight, critical_threshold) ON m.module = d.module""")


@register("module_thresholds", "R21 N9 (config deep merge)", _thresholds_sql())
def q_module_thresholds(t):
    return RU.module_thresholds(R.module_breakdown(t.issues), C.Config.from_dict(_MODCFG))


# ------------------------------------------------------------ verification

from defectlens.operators import verify as V  # noqa: E402

_CRIT_RAW = "o_orderpriority IN ('1-URGENT', '2-HIGH')"


def _rec_ctes():
    raw = f"""b AS (SELECT {'CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER)'} AS sprint_num,
  count(*) AS total_b, count_if({_CRIT_RAW}) AS critical_b,
  count_if(NOT (l_linestatus = 'F') AND o_orderstatus NOT IN ('P', 'F')) AS pending_b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""
    a = f"""a AS (SELECT sprint_num, count(*) AS total_a, count_if(priority IN ({lst(C.DEFAULT_PRIORITIES['critical'])}))
  AS critical_a, count_if(status = 'To Do') AS pending_a FROM issue GROUP BY sprint_num)"""
    rec = """rec AS (SELECT coalesce(a.sprint_num, b.sprint_num) AS sprint_num, total_a, critical_a, pending_a,
  total_b, critical_b, pending_b,
  total_a IS NOT DISTINCT FROM total_b AS total_match, critical_a IS NOT DISTINCT FROM critical_b AS critical_match,
  pending_a IS NOT DISTINCT FROM pending_b AS pending_match,
  total_a IS NOT NULL AND total_b IS NOT NULL AS in_both
  FROM a FULL OUTER JOIN b ON a.sprint_num = b.sprint_num)"""
    return a, raw, rec


def _rec_frames(t):
    iss = t.issues
    a = V.sprint_counts(iss, F.col("priority").isin(C.DEFAULT_PRIORITIES["critical"]), F.col("status") == "To Do")
    raw = t.raw_facts
    b = V.sprint_counts(raw, F.col("is_critical"), F.col("status") == "To Do")
    return V.reconcile_sprints(a, b)


@register("reconcile_sprints", "J1 V2 (issue table vs raw lineitem x orders)", with_issue(
    "SELECT *, total_match AND critical_match AND pending_match AS all_match FROM rec", *_rec_ctes()))
def q_reconcile_sprints(t):
    return _rec_frames(t)


@register("match_percentage", "V1 V3 V4", with_issue(f"""
SELECT total_a, total_b, sprints_a, sprints_b, compared, matched, total_a = total_b AS totals_match,
  sprints_a = sprints_b AS sprints_match, match_percentage,
  CASE WHEN match_percentage > 80 THEN 'success' ELSE 'warning' END AS status,
  concat_ws(' | ',
    CASE WHEN total_a = total_b THEN 'Total bugs matches'
         ELSE concat('Total bugs different: A=', CAST(total_a AS VARCHAR), ', B=', CAST(total_b AS VARCHAR)) END,
    CASE WHEN sprints_a = sprints_b THEN 'Number of sprints matches'
         ELSE concat('Number of sprints different: A=', CAST(sprints_a AS VARCHAR), ', B=', CAST(sprints_b AS VARCHAR)) END,
    CASE WHEN match_percentage = 100 THEN 'All sprints match 100%'
         ELSE concat('Only ', CAST(match_percentage AS VARCHAR), '% of sprints match completely') END) AS messages
FROM (SELECT CAST(coalesce(sum(total_a), 0) AS BIGINT) AS total_a, CAST(coalesce(sum(total_b), 0) AS BIGINT) AS total_b,
        count(total_a) AS sprints_a, count(total_b) AS sprints_b, count_if(in_both) AS compared,
        count_if(in_both AND total_match AND critical_match AND pending_match) AS matched,
        CASE WHEN count_if(in_both) > 0 THEN
          {jr('count_if(in_both AND total_match AND critical_match AND pending_match) / count_if(in_both) * 100')}
          ELSE CAST(100 AS BIGINT) END AS match_percentage
      FROM rec)""", *_rec_ctes()))
def q_match_percentage(t):
    return V.reconciliation_summary(_rec_frames(t))


@register("validate_records", "V5 (row-level checks on the sprint roll-up)", with_issue("""
SELECT sprint, sprint_num, len(errs) = 0 AS is_valid, len(errs) AS n_errors, array_to_string(errs, '; ') AS errors
FROM (SELECT sprint, sprint_num, list_filter([
    CASE WHEN sprint IS NULL OR trim(sprint) = '' THEN 'missing sprint label' END,
    CASE WHEN sprint_num IS NULL THEN 'missing sprint number' END,
    CASE WHEN bugs IS NULL OR bugs < 0 THEN 'invalid bugs' END,
    CASE WHEN bugs_resolved > bugs THEN 'resolved exceeds bugs' END,
    CASE WHEN bugs_pending < 0 THEN 'negative pending' END,
    CASE WHEN bugs_resolved + bugs_pending <> bugs THEN 'resolved + pending != bugs' END,
    CASE WHEN test_cases < 0 THEN 'negative executed cases' END,
    CASE WHEN test_cases > test_planned THEN 'executed exceeds planned' END,
    CASE WHEN critical_pending > critical_total THEN 'critical pending exceeds critical' END],
    lambda x: x IS NOT NULL) AS errs FROM sprint)""", sprint_cte([])))
def q_validate_records(t):
    return V.validate_sprint_rows(sprint_frame(t.issues))
