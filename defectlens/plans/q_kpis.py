"""KPI, prediction, maturity, cycle-time and sprint roll-up queries (K*, A16,
A18-A21, E2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import filters as FL
from defectlens.operators import kpis as K
from defectlens.operators import rollups as R
from defectlens.operators.sprints import sprint_frame
from defectlens.plans.catalog import register
from defectlens.plans.sqlfrag import clamp, f1, f2, f6, jr, lst, pct, truthy_or, with_issue

CRIT = lst(C.DEFAULT_PRIORITIES["critical"])
DAYS = "datediff('day', created_at, resolved_at)"


def sprint_cte(by: list[str]) -> str:
    """The sprint roll-up (operators.sprints.sprint_frame) in DuckDB SQL."""
    b = "".join(f"{k}, " for k in by)
    return f"""sprint AS (
  SELECT {b}sprint, sprint_num, count(*) AS bugs, count_if(status = 'Done') AS bugs_resolved,
    count(*) - count_if(status = 'Done') AS bugs_pending,
    CAST(sum(cases_executed) AS BIGINT) AS test_cases, CAST(sum(cases_planned) AS BIGINT) AS test_planned,
    count_if(status = 'Done') AS velocity, count(*) AS planned_velocity,
    count_if(priority IN ({CRIT})) AS critical_total,
    count_if(priority IN ({CRIT}) AND NOT (status = 'Done')) AS critical_pending,
    count_if(environment = 'PROD') AS production_bugs,
    CAST(coalesce(sum(CASE WHEN status = 'Done' THEN cases_executed END), 0) AS BIGINT) AS tc_passed,
    count_if(priority IN ({lst(C.CRITICAL_LABELS_ALL)})) AS crit_all,
    count_if(priority IN ({CRIT}) AND status IN ({lst(C.PENDING_STATUS_PRIORITY_VIEW)})) AS crit_pending_view,
    count_if(status IN ({lst(C.REOPENED_STATUS)})) AS reopened,
    count_if(priority = 'Más alta') AS c_mas_alta, count_if(priority = 'Alta') AS c_alta,
    CAST(coalesce(sum(CASE WHEN {DAYS} > 0 THEN {DAYS} END), 0) AS BIGINT) AS res_days_sum,
    count_if({DAYS} > 0) AS res_days_n
  FROM issue GROUP BY {b}sprint, sprint_num)"""


def ft(*cols, default="0") -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, 0)" for c in cols) + f", {default})"


def inputs_cte(by: list[str]) -> str:
    b = ", ".join(by)
    sel = (b + ", ") if by else ""
    grp = f" GROUP BY {b}" if by else ""
    s = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
    return f"""inp AS (
  SELECT {sel}count(*) AS n, {s('bugs')} AS sum_bugs, {s('bugs_resolved')} AS sum_resolved,
    {s(f"greatest({ft('test_cases', 'bugs')}, 0)")} AS sum_cases, {s('velocity')} AS sum_velocity,
    {s(ft('planned_velocity', 'velocity'))} AS sum_planned,
    avg(bugs) AS avg_bugs, stddev_pop(bugs) AS std_bugs, avg(velocity) AS avg_velocity,
    stddev_pop(velocity) AS std_velocity, arg_min(bugs, sprint_num) AS first_bugs,
    arg_max(bugs, sprint_num) AS last_bugs,
    {s('bugs')} AS total_bugs, {s('bugs_resolved')} AS bugs_closed, {s('test_planned')} AS tc_total,
    {s('test_cases')} AS tc_executed, {s('tc_passed')} AS tc_passed, {s('production_bugs')} AS production_bugs,
    {s('reopened')} AS rework_bugs, {s('crit_all')} AS crit_all, {s('critical_total')} AS crit_cfg,
    {s('crit_pending_view')} AS crit_pending, {s('res_days_sum')} AS res_days_sum, {s('res_days_n')} AS res_days_n
  FROM sprint{grp})"""


def kpi_cte(by: list[str], cfg: C.Config | None = None) -> str:
    cfg = cfg or C.Config()
    w = cfg.weights
    b = "".join(f"{k}, " for k in by)
    tct = truthy_or("tc_total", "1")
    trend = ("(CASE WHEN n < 2 OR first_bugs IS NULL OR first_bugs = 0 THEN CAST(0 AS BIGINT) "
             f"ELSE {jr('(last_bugs - first_bugs) / first_bugs * 100')} END)")
    cvb = "(CASE WHEN avg_bugs > 0 THEN std_bugs / avg_bugs ELSE 1.0::DOUBLE END)"
    cvv = "(CASE WHEN avg_velocity > 0 THEN std_velocity / avg_velocity ELSE 1.0::DOUBLE END)"
    cons = (f"(CASE WHEN n < 3 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, "
            f"1.0::DOUBLE - ({cvb} + {cvv}) / 2)) END)")
    conf = (f"(CASE WHEN n < 3 THEN CAST(60 AS BIGINT) WHEN avg_bugs > 0 THEN "
            f"{jr('greatest(60.0::DOUBLE, least(95.0::DOUBLE, 100.0::DOUBLE - std_bugs / avg_bugs * 100))')} END)")
    exec_rate = jr(f"tc_executed / {tct} * 100")
    rr = "(CASE WHEN total_bugs > 0 THEN bugs_closed / total_bugs * 100 ELSE 100.0::DOUBLE END)"
    cov = f"(tc_executed / {tct} * 100)"
    dens = ("(CASE WHEN tc_executed > 0 THEN greatest(0.0::DOUBLE, 100 - total_bugs / tc_executed * 50) "
            "ELSE 100.0::DOUBLE END)")
    cs = "(CASE WHEN total_bugs > 0 THEN greatest(0.0::DOUBLE, 100 - crit_all / total_bugs * 100) ELSE 100.0::DOUBLE END)"
    qi = (f"({rr} * {w['resolutionRate']}::DOUBLE + {cov} * {w['testCoverage']}::DOUBLE "
          f"+ {dens} * {w['bugDensity']}::DOUBLE + {cs} * {w['criticalBugs']}::DOUBLE)")
    avg_ps = f"(CASE WHEN n > 0 THEN {jr('sum_bugs / n')} ELSE CAST(0 AS BIGINT) END)"
    rt = (f"(CASE WHEN res_days_n > 0 THEN CAST({jr('res_days_sum / res_days_n')} AS DOUBLE) "
          f"WHEN n > 0 AND sum_resolved > 0 THEN {f1(f'{C.SPRINT_DAYS} * n / sum_resolved')} "
          f"WHEN bugs_closed > 0 THEN {f1(f'greatest(n, 1) * {C.SPRINT_DAYS} / bugs_closed')} ELSE 7.0::DOUBLE END)")
    eff = "(CASE WHEN total_bugs > 0 THEN bugs_closed / total_bugs * 100 ELSE 0.0::DOUBLE END)"
    auto = f"{float(cfg.test_automation)}::DOUBLE"
    pred = "1.0" if cfg.count_predictions_in_maturity else "0.0"
    mat = jr(f"(least({exec_rate} / 20, 1.0::DOUBLE) + least({auto} / 20, 1.0::DOUBLE) "
             f"+ least({eff} / 20, 1.0::DOUBLE) + {cons} + {pred}::DOUBLE) / 5 * 5")
    level = "CASE maturity_score " + " ".join(
        f"WHEN {k} THEN '{v}'" for k, v in sorted(C.MATURITY_LEVELS.items())) + " END"
    rework = truthy_or("rework_bugs", jr("total_bugs * 0.15::DOUBLE"))
    tot1 = truthy_or("total_bugs", "1")
    return f"""k0 AS (
  SELECT {b}n AS n_sprints, total_bugs, bugs_closed, tc_executed, crit_cfg AS critical_total,
    (CASE WHEN n > 0 THEN {jr('sum_cases / n')} ELSE CAST(0 AS BIGINT) END) AS avg_test_cases_per_sprint,
    {pct('bugs_closed', 'total_bugs')} AS resolution_efficiency,
    (CASE WHEN tc_executed > 0 THEN {f2('total_bugs / tc_executed')} ELSE 0.0::DOUBLE END) AS defect_density,
    {jr(clamp(qi, '0', '100'))} AS quality_index,
    {trend} AS sprint_trend,
    crit_all AS critical_count,
    {pct('crit_cfg', 'total_bugs')} AS critical_ratio,
    crit_pending AS critical_pending,
    {rt} AS avg_resolution_time,
    {exec_rate} AS test_execution_rate,
    {jr(f'production_bugs / {tot1} * 100')} AS leakage_rate,
    {jr(f'production_bugs / ({tot1} + production_bugs) * 100')} AS escape_rate,
    (CASE WHEN total_bugs > 0 THEN {jr(f'{rework} / total_bugs * 100')} ELSE CAST(0 AS BIGINT) END) AS rework_rate,
    {jr(f"tc_passed / {truthy_or('tc_executed', '1')} * 100")} AS first_pass_yield,
    {pct('sum_velocity', 'sum_planned')} AS burndown_efficiency,
    {avg_ps} AS avg_bugs_per_sprint,
    {f6(cons)} AS consistency,
    {conf} AS prediction_confidence,
    {mat} AS maturity_score,
    CAST(total_bugs * {C.COST_BUG_PRODUCTION - C.COST_BUG_DEVELOPMENT} AS BIGINT) AS savings,
    (CASE WHEN total_bugs > 0 THEN {jr(f'total_bugs * {C.COST_BUG_PRODUCTION - C.COST_BUG_DEVELOPMENT} / (total_bugs * {C.COST_BUG_DEVELOPMENT}) * 100')} END) AS roi,
    {jr(f'{avg_ps} * (1 + {trend} / 100)')} AS next_sprint_bugs,
    CASE WHEN {trend} > 0 THEN 'up' ELSE 'down' END AS next_sprint_trend,
    CAST(CASE WHEN {trend} > 10 THEN greatest(75 - 5, 0) WHEN {trend} < -10 THEN least(75 + 5, 100) ELSE 75 END AS BIGINT)
      AS quality_prediction,
    CASE WHEN {trend} > 10 THEN 'down' WHEN {trend} < -10 THEN 'up' ELSE 'stable' END AS quality_direction
  FROM inp),
kpi AS (SELECT *, {level} AS maturity_level FROM k0)"""


def kpi_sql(by: list[str], body: str = "SELECT * FROM kpi") -> str:
    return with_issue(body, sprint_cte(by), inputs_cte(by), kpi_cte(by))


def _sprints(t, by=None):
    return sprint_frame(t.issues, by)


@register("kpis_overall", "K1-K20 K35 W1 (one agg pass)", kpi_sql([]))
def q_kpis_overall(t):
    return K.kpis(_sprints(t), [])


@register("kpis_by_module", "K1-K20 K35 W1 by module", kpi_sql(["module"]))
def q_kpis_by_module(t):
    return K.kpis(_sprints(t, ["module"]), ["module"])


@register("kpis_by_environment", "K1-K20 K35 by environment", kpi_sql(["environment"]))
def q_kpis_by_environment(t):
    return K.kpis(_sprints(t, ["environment"]), ["environment"])


def _num_str(e: str) -> str:
    return f"(CASE WHEN {e} = floor({e}) THEN CAST(CAST(floor({e}) AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END)"


@register("predictions_by_module", "K21 K22 K23 K18", kpi_sql(["module"], f"""
SELECT module, 1 AS ord, 'Bugs Próximo Sprint' AS metric, CAST(next_sprint_bugs AS VARCHAR) AS value,
       next_sprint_trend AS trend, prediction_confidence AS confidence FROM kpi
UNION ALL SELECT module, 2, 'Tiempo Resolución', concat({_num_str('avg_resolution_time')}, ' días'), 'stable',
       CAST(85 AS BIGINT) FROM kpi
UNION ALL SELECT module, 3, 'Quality Index', concat(CAST(quality_prediction AS VARCHAR), '%'), quality_direction,
       prediction_confidence FROM kpi"""))
def q_predictions_by_module(t):
    return K.predictions(K.kpis(_sprints(t, ["module"]), ["module"]), ["module"])


@register("maturity_by_module", "K19 K17 K10", kpi_sql(["module"], """
SELECT module, maturity_score, maturity_level, concat(CAST(maturity_score AS VARCHAR), '/5') AS maturity,
       test_execution_rate, resolution_efficiency, consistency FROM kpi"""))
def q_maturity_by_module(t):
    return K.maturity(K.kpis(_sprints(t, ["module"]), ["module"]), ["module"])


def cycle_cte(by: str = "module") -> str:
    """``cyc``: K24/K25 per group (operators.kpis.cycle_time) in SQL; needs ``sprint``."""
    levels = [("critical", "Más alta", 5, 0.5, True), ("high", "Alta", 8, 0.8, True),
              ("medium", "Media", 14, 1.0, False), ("low", "Baja", 21, 1.5, True)]
    cols = []
    for name, lab, f, m, r in levels:
        fb = f"CAST({jr(f'avg_ct * {m}::DOUBLE')} AS DOUBLE)" if r else "avg_ct"
        cols.append(f"(CASE WHEN coalesce({name}_r, 0) > 0 THEN "
                    f"{f1(f'(coalesce({name}_c, 0) - coalesce({name}_r, 0)) / coalesce({name}_r, 0) * {f}')} "
                    f"ELSE {fb} END) AS {name}_days")
    pr = ", ".join(f"sum(CASE WHEN priority = '{lab}' THEN c END) AS {name}_c, "
                   f"sum(CASE WHEN priority = '{lab}' THEN c - p END) AS {name}_r"
                   for name, lab, *_ in levels)
    pend = lst(C.PENDING_STATUS_PRIORITY_VIEW)
    return f"""cyc AS (
SELECT s.{by}, greatest(avg_ct, 1.0::DOUBLE) AS cycle_time, {", ".join(cols)}
FROM (SELECT {by}, n, tb, tr,
        CASE WHEN tr / (n * {C.SPRINT_DAYS}) > 0 THEN {f1(f'(tb / n) / (tr / (n * {C.SPRINT_DAYS}))')}
             ELSE {float(C.SPRINT_DAYS)}::DOUBLE END AS avg_ct
      FROM (SELECT {by}, count(*) AS n, sum(bugs) AS tb, sum(bugs_resolved) AS tr FROM sprint GROUP BY {by})) s
JOIN (SELECT {by}, {pr} FROM (SELECT {by}, priority, count(*) AS c, count_if(status IN ({pend})) AS p
      FROM issue GROUP BY {by}, priority) GROUP BY {by}) q ON s.{by} IS NOT DISTINCT FROM q.{by})"""


def _cycle_sql() -> str:
    return with_issue("SELECT * FROM cyc", sprint_cte(["module"]), cycle_cte("module"))


@register("cycle_time_by_priority", "K24 K25 A12", _cycle_sql())
def q_cycle_time_by_priority(t):
    iss = t.issues
    return K.cycle_time(sprint_frame(iss, ["module"]), R.priority_breakdown(iss, ["module"]), ["module"])


@register("resolution_days", "K37 K9", with_issue(f"""
SELECT module, count_if({DAYS} > 0) AS n_resolved,
       {f1(f'avg(CASE WHEN {DAYS} > 0 THEN {DAYS} END)')} AS avg_days,
       max(CASE WHEN {DAYS} > 0 THEN {DAYS} END) AS max_days,
       min(CASE WHEN {DAYS} > 0 THEN {DAYS} END) AS min_days
FROM issue GROUP BY module"""))
def q_resolution_days(t):
    return K.resolution_days(t.issues, ["module"])


@register("automation_estimate", "K28 W14 (per sprint and summary)", with_issue(f"""
SELECT module, sprint, sprint_num, test_cases, auto_tests, test_cases - auto_tests AS manual_tests,
       (CASE WHEN test_cases > 0 THEN {jr('auto_tests / test_cases * 100')} ELSE CAST(0 AS BIGINT) END) AS auto_pct,
       {jr('avg(CASE WHEN test_cases > 0 THEN auto_tests / test_cases * 100 ELSE 0.0::DOUBLE END) OVER (PARTITION BY module)')}
         AS coverage,
       CAST(sprint_num = max(sprint_num) OVER (PARTITION BY module) AS BOOLEAN) AS is_last
FROM (SELECT module, sprint, sprint_num, test_cases,
        {jr(f"test_cases * (0.35::DOUBLE + {truthy_or('velocity', '15')} / 20 * 0.25::DOUBLE)")} AS auto_tests
      FROM sprint)""", sprint_cte(["module"])))
def q_automation_estimate(t):
    return K.automation_estimate(_sprints(t, ["module"]), ["module"])


@register("sprint_rollup", "A16 A1 N6", with_issue(f"""
SELECT sprint, sprint_num, bugs, bugs - pending AS bugs_resolved, pending AS bugs_pending,
       {jr('bugs / 7')} AS velocity_est, {jr('bugs * 1.2::DOUBLE / 7')} AS planned_velocity_est,
       critical_total, {jr('critical_total / 2')} AS critical_pending_est
FROM (SELECT sprint, sprint_num, count(*) AS bugs, count_if(status IN ('To Do')) AS pending,
        count_if(priority IN ({CRIT})) AS critical_total FROM issue GROUP BY sprint, sprint_num)"""))
def q_sprint_rollup(t):
    return K.sprint_rollup_document(t.issues)


_SEL = dict(status="done, to do", priority="Más alta,alta", environment="prod, uat, sit")


@register("filtered_summary", "E2 F1 F3 A18 F13", with_issue("""
SELECT count(*) AS total_bugs,
       count_if(lower(status) IN ('cerrado', 'closed', 'done', 'resuelto', 'resolved')) AS bugs_closed
FROM issue WHERE lower(status) IN ('done', 'to do') AND lower(priority) IN ('más alta', 'alta')
  AND lower(environment) IN ('prod', 'uat', 'sit')"""))
def q_filtered_summary(t):
    src = t.issues
    iss = src.filter(FL.issue_filter(columns=src.columns, **_SEL))
    return iss.agg(F.count(F.lit(1)).alias("total_bugs"), F.count_if(FL.closed_exact()).alias("bugs_closed"))


@register("filtered_sprints", "E2 F2 J2 (semi-join through names)", with_issue(f"""
SELECT s.sprint, s.sprint_num, s.bugs, s.bugs_resolved, s.test_cases
FROM sprint s
WHERE contains(lower(s.sprint), 'sprint 7')
   OR s.sprint IN (SELECT sprint FROM issue WHERE lower(status) IN ('done', 'to do')
                   AND lower(priority) IN ('más alta', 'alta') AND lower(environment) IN ('prod', 'uat', 'sit')
                   AND len(list_intersect(tags, ['green'])) > 0)""", sprint_cte([])))
def q_filtered_sprints(t):
    iss = t.issues
    sel = iss.filter(FL.issue_filter(tags="green", columns=iss.columns, **_SEL))
    return K.sprints_matching(sprint_frame(iss), sel, ["sprint 7"]).select(
        "sprint", "sprint_num", "bugs", "bugs_resolved", "test_cases")


@register("sprint_year_totals", "A19 A20 (partial: no fallback by priority label) A21 A33 (sprint selection = one year of sprints)", with_issue(f"""
SELECT year, CAST(sum(bugs) AS BIGINT) AS total_bugs, CAST(sum(bugs_resolved) AS BIGINT) AS total_resolved,
       CAST(sum(test_cases) AS BIGINT) AS total_executed, CAST(sum({ft('test_planned', 'test_cases')}) AS BIGINT) AS total_planned,
       CAST(sum(critical_total) AS BIGINT) AS critical_total, CAST(sum(critical_pending) AS BIGINT) AS critical_pending,
       {f1('avg(bugs)')} AS avg_bugs_per_sprint, max(bugs) AS max_bugs, min(bugs) AS min_bugs, count(*) AS n_sprints,
       {pct('sum(test_cases)', f"sum({ft('test_planned', 'test_cases')})")} AS execution_rate
FROM (SELECT *, CAST(floor((sprint_num - 1) / 12) + 1995 AS INTEGER) AS year FROM sprint) GROUP BY year""",
    sprint_cte([])))
def q_sprint_year_totals(t):
    sp = sprint_frame(t.issues).withColumn(
        "year", (F.floor((F.col("sprint_num") - 1) / 12) + 1995).cast("int"))
    return R.selected_sprint_totals(sp, ["year"])
