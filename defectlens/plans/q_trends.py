"""Trend, series and comparison queries (W1-W24) over the sprint roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens.operators import trends as TR
from defectlens.operators.sprints import sprint_frame
from defectlens.plans.catalog import register
from defectlens.plans.q_kpis import ft, sprint_cte
from defectlens.plans.sqlfrag import clamp, f1, f2, jr, pct, truthy_or, with_issue

BY = ["module"]


def _sp(t):
    return sprint_frame(t.issues, BY)


def sq(body: str, *extra: str) -> str:
    return with_issue(body, sprint_cte(BY), *extra)


_QUAL = jr(clamp("(100 - coalesce(bugs, 0) * 2 + least(coalesce(test_cases, 0) / 10, 20.0::DOUBLE) + "
                 f"CASE WHEN coalesce(bugs_resolved, 0) <> 0 THEN bugs_resolved / {truthy_or('bugs', '1')} * 10 "
                 "ELSE 0.0::DOUBLE END)", "0.0::DOUBLE", "100.0::DOUBLE"))


@register("sprint_trends", "W23 W2 W3 W4 W5 W7 W8 N6", sq(f"""
SELECT module, sprint, sprint_num, bugs, bugs_resolved AS resolved, bugs_pending AS pending,
  {pct('bugs_resolved', 'bugs_resolved + bugs_pending')} AS resolution_rate, {_QUAL} AS quality,
  velocity, {ft('planned_velocity', 'velocity')} AS planned,
  CASE WHEN planned_velocity > 0 THEN {jr('velocity / planned_velocity * 100')} ELSE CAST(100 AS BIGINT) END
    AS velocity_efficiency,
  CASE WHEN test_cases <> 0 THEN least(test_cases / 100 * 100, 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS coverage,
  CASE WHEN test_cases > 0 THEN {f2('bugs / test_cases')} ELSE 0.0::DOUBLE END AS density
FROM sprint"""))
def q_sprint_trends(t):
    return TR.sprint_trends(_sp(t), BY)


@register("velocity_change", "W6", sq(f"""
SELECT module, sprint, sprint_num, velocity,
  CASE WHEN prev > 0 THEN {jr('(velocity - prev) / prev * 100')} ELSE CAST(0 AS BIGINT) END AS change
FROM (SELECT *, coalesce(lag(velocity) OVER (PARTITION BY module ORDER BY sprint_num, sprint), velocity) AS prev,
        count(*) OVER (PARTITION BY module) AS n FROM sprint) WHERE n >= 2"""))
def q_velocity_change(t):
    return TR.velocity_change(_sp(t), BY)


def _band_ratio(d):
    return (f"CASE WHEN {d} <= 0.1 THEN 'Excelente' WHEN {d} <= 0.3 THEN 'Bueno' WHEN {d} <= 0.5 THEN 'Alerta' "
            f"ELSE 'Crítico' END")


def _band_pct(d):
    return (f"CASE WHEN {d} <= 15 THEN 'Excelente' WHEN {d} <= 25 THEN 'Bueno' WHEN {d} <= 35 THEN 'Aceptable' "
            f"ELSE 'Crítico' END")


@register("density_series", "W8 R13 R15", sq(f"""
SELECT module, sprint, sprint_num, bugs, test_cases, density, {_band_ratio('density')} AS band,
       {_band_pct('density * 100')} AS band_pct
FROM (SELECT *, CASE WHEN test_cases > 0 THEN {f2('bugs / test_cases')} ELSE 0.0::DOUBLE END AS density FROM sprint)"""))
def q_density_series(t):
    return TR.density_series(_sp(t), BY)


def _first_last(by: str, src: str, value: str) -> str:
    return f"""
SELECT {by}, n_sprints, first_value, last_value,
  CASE WHEN n_sprints < 2 OR first_value = 0 THEN CAST(0 AS BIGINT)
       ELSE {jr('(last_value - first_value) / first_value * 100')} END AS trend,
  CASE WHEN n_sprints >= 2 THEN {jr(f"(last_value - first_value) / {truthy_or('abs(first_value)', '1')} * 100")} END
    AS series_change
FROM (SELECT {by}, count(*) AS n_sprints, arg_min({value}, sprint_num) AS first_value,
        arg_max({value}, sprint_num) AS last_value FROM {src} GROUP BY {by})"""


@register("sprint_first_last_change", "W1 W16", sq(_first_last("module", "sprint", "bugs")))
def q_first_last(t):
    return TR.first_last_change(_sp(t), BY)


def _half_sql() -> str:
    planned = ft("test_planned", "test_cases")
    ms = {
        "test_cases_trend": "coalesce(test_cases, 0)",
        "resolution_trend": "CASE WHEN bugs > 0 THEN bugs_resolved / bugs * 100 ELSE 0.0::DOUBLE END",
        "critical_bugs_trend": "coalesce(bugs, 0)",
        "execution_trend": f"CASE WHEN {planned} > 0 THEN {jr(f'test_cases / {planned} * 100')} ELSE CAST(0 AS BIGINT) END",
    }
    sel = ", ".join(f"{v} AS {k}" for k, v in ms.items())
    aggs = ", ".join(f"avg(CASE WHEN rn <= floor(n / 2) THEN {k} END) AS {k}__a, "
                     f"avg(CASE WHEN NOT (rn <= floor(n / 2)) THEN {k} END) AS {k}__b" for k in ms)
    outs = []
    for k in ms:
        e = (f"CASE WHEN n_sprints < 2 OR {k}__a IS NULL OR {k}__a = 0 THEN CAST(0 AS BIGINT) "
             f"ELSE {jr(f'({k}__b - {k}__a) / {k}__a * 100')} END")
        outs.append(f"-({e}) AS {k}" if k == "critical_bugs_trend" else f"{e} AS {k}")
    return sq(f"""
SELECT module, n_sprints, {", ".join(outs)}
FROM (SELECT module, max(n) AS n_sprints, {aggs}
      FROM (SELECT module, {sel}, row_number() OVER (PARTITION BY module ORDER BY sprint_num, sprint) AS rn,
              count(*) OVER (PARTITION BY module) AS n FROM sprint) GROUP BY module)""")


@register("half_split_trend", "W9 W10", _half_sql())
def q_half_split(t):
    return TR.half_split_trends(_sp(t), BY)


_LONG = " UNION ALL ".join(
    f"SELECT module, sprint, sprint_num, '{m}' AS metric, {inv} AS inverse, CAST({v} AS BIGINT) AS value FROM sprint"
    for m, inv, v in [("bugs", "true", "bugs"), ("bugs_resolved", "false", "bugs_resolved"),
                      ("test_cases", "false", "test_cases"),
                      ("resolution_rate", "false", pct("bugs_resolved", "bugs")),
                      ("critical_bugs", "true", "critical_total")])

_CMP_CTE = f"""cmp AS (
SELECT module, metric, previous, current, mean, current - previous AS delta,
  CASE WHEN previous <> 0 THEN {jr('(current - previous) / previous * 100')} ELSE CAST(0 AS BIGINT) END AS delta_pct,
  {f1('current - mean')} AS delta_mean,
  CASE WHEN mean <> 0 THEN {jr(f"{f1('current - mean')} / mean * 100")} ELSE CAST(0 AS BIGINT) END AS delta_mean_pct,
  CASE WHEN current - previous = 0 THEN 'same'
       WHEN (CASE WHEN inverse THEN current - previous < 0 ELSE current - previous > 0 END) THEN 'better'
       ELSE 'worse' END AS direction,
  CASE WHEN {f1('current - mean')} = 0 THEN 'same'
       WHEN (CASE WHEN inverse THEN {f1('current - mean')} < 0 ELSE {f1('current - mean')} > 0 END) THEN 'better'
       ELSE 'worse' END AS direction_mean
FROM (SELECT module, metric, inverse, count(*) AS n, max(CASE WHEN rk = 2 THEN value END) AS previous,
        max(CASE WHEN rk = 1 THEN value END) AS current, {f1('avg(value)')} AS mean
      FROM (SELECT *, row_number() OVER (PARTITION BY module, metric ORDER BY sprint_num DESC, sprint DESC) AS rk
            FROM ({_LONG})) GROUP BY module, metric, inverse HAVING count(*) >= 2))"""


@register("sprint_comparison", "W11 W12 W24", sq("SELECT * FROM cmp", _CMP_CTE))
def q_sprint_comparison(t):
    return TR.sprint_comparison(_sp(t), BY)


_PC = f"(CASE WHEN previous <> 0 THEN {jr('delta / previous * 100')} END)"


@register("comparison_findings", "W13", sq(f"""
SELECT module, 'Total Bugs Reduction' AS finding, abs(delta) AS amount, abs({_PC}) AS amount_pct FROM cmp
  WHERE metric = 'bugs' AND delta < 0
UNION ALL SELECT module, 'Increase in Bugs', delta, {_PC} FROM cmp WHERE metric = 'bugs' AND delta > 0
UNION ALL SELECT module, 'Resolution Improvement', delta, {_PC} FROM cmp WHERE metric = 'bugs_resolved' AND delta > 0
UNION ALL SELECT module, 'Resolution Rate Improvement', delta, CAST(NULL AS BIGINT) FROM cmp
  WHERE metric = 'resolution_rate' AND delta > 0
UNION ALL SELECT module, 'Resolution Rate Reduction', abs(delta), CAST(NULL AS BIGINT) FROM cmp
  WHERE metric = 'resolution_rate' AND delta < 0""", _CMP_CTE))
def q_comparison_findings(t):
    return TR.comparison_findings(TR.sprint_comparison(_sp(t), BY), BY)


def _series_sql() -> str:
    planned = ft("test_planned", "test_cases")
    eff = f"(CASE WHEN bugs > 0 THEN {jr('bugs_resolved / bugs * 100')} END)"
    auto = jr(f"test_cases * (0.35::DOUBLE + {truthy_or('velocity', '15')} / 20 * 0.25::DOUBLE)")
    vals = [
        ("execution_rate", f"CASE WHEN {planned} > 0 THEN {jr(f'test_cases / {planned} * 100')} ELSE 0 END"),
        ("test_cases", "coalesce(test_cases, 0)"),
        ("resolution_efficiency", f"coalesce({eff}, 0)"),
        ("automation_coverage", f"CASE WHEN test_cases > 0 THEN {jr(f'{auto} / test_cases * 100')} ELSE 0 END"),
        ("critical_bugs", "critical_total"),
        ("critical_bugs_pending", "critical_pending"),
        ("cycle_time", jr(f"15 - {truthy_or(eff, '70')} / 10")),
        ("bugs", "bugs"),
        ("defect_density", f"CASE WHEN test_cases > 0 THEN {f2('bugs / test_cases')} ELSE 0.0::DOUBLE END"),
        ("test_efficiency", f"CASE WHEN {planned} > 0 THEN {jr(f'test_cases / {planned} * 100')} ELSE 0 END"),
        ("bug_leakage", jr(f"production_bugs / {truthy_or('bugs', '1')} * 100")),
        ("resolution_time", f"CASE WHEN res_days_n > 0 THEN {jr('res_days_sum / res_days_n')} ELSE 0 END"),
    ]
    return " UNION ALL ".join(
        f"SELECT module, sprint, sprint_num, '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM sprint"
        for k, v in vals)


@register("metric_series", "W14 W15", sq(_series_sql()))
def q_metric_series(t):
    return TR.metric_series(_sp(t), BY)


@register("series_change", "W16 over W14/W15", sq(
    _first_last("module, metric", "series", "value"), f"series AS ({_series_sql()})"))
def q_series_change(t):
    return TR.series_change(TR.metric_series(_sp(t), BY), BY)


@register("executed_vs_planned", "W17", sq(f"""
SELECT module, sprint, sprint_num, test_cases AS executed, test_planned AS planned,
  {pct('test_cases', 'test_planned')} AS execution_pct FROM sprint"""))
def q_executed_vs_planned(t):
    return TR.executed_vs_planned(_sp(t), BY)


def _prs_sql() -> str:
    rate = f"(bugs_resolved / {truthy_or('bugs', '1')})"
    cx = f"(bugs / {truthy_or('velocity', '1')})"
    parts = []
    for lvl, base, f, g, lo, hi, target in TR.RESOLUTION_LEVELS:
        cxf = cx if f == 1.0 else f"{cx} * {f}::DOUBLE"
        days = f"CAST(greatest({lo}, least({hi}, {jr(f'{base} + {cxf} - {rate} * {g}::DOUBLE')})) AS BIGINT)"
        parts.append(f"SELECT module, sprint, sprint_num, '{lvl}' AS level, {days} AS days, "
                     f"CAST({target} AS BIGINT) AS target FROM sprint")
    return sq("SELECT *, days <= target AS meets_target, days - target AS gap FROM (" + " UNION ALL ".join(parts) + ")")


@register("priority_resolution_series", "W18 W19", _prs_sql())
def q_priority_resolution_series(t):
    return TR.priority_resolution_series(_sp(t), BY)


def _sev_eff_sql() -> str:
    ratio = f"(bugs_resolved / {truthy_or('bugs', '1')})"
    parts = []
    for lab, share in TR.SEVERITY_SHARES:
        tot = jr(f"coalesce(bugs, 0) * {share}::DOUBLE")
        res = jr(f"{tot} * {ratio}")
        parts.append(f"SELECT module, sprint, sprint_num, '{lab}' AS severity, {tot} AS total, {res} AS resolved, "
                     f"CASE WHEN {tot} > 0 THEN {jr(f'{res} / {tot} * 100')} ELSE CAST(0 AS BIGINT) END AS efficiency "
                     f"FROM sprint")
    return sq(" UNION ALL ".join(parts))


@register("severity_efficiency", "W20", _sev_eff_sql())
def q_severity_efficiency(t):
    return TR.severity_efficiency(_sp(t), BY)


_SEV_COLS = {"Más alta": "c_mas_alta", "Alta": "c_alta", "Media": "c_media", "Baja": "c_baja"}


def _sev_fixed_sql() -> str:
    parts = []
    for lab, share in TR.SEVERITY_SHARES:
        est = jr(f"coalesce(bugs, 0) * {share}::DOUBLE")
        v = f"coalesce(CAST({_SEV_COLS[lab]} AS BIGINT), {est})" if lab in _SEV_COLS else est
        parts.append(f"SELECT module, sprint, sprint_num, '{lab}' AS severity, {v} AS count FROM sp")
    cnt = ", ".join(f"count_if(priority = '{lab}') AS {c}" for lab, c in _SEV_COLS.items())
    return with_issue(" UNION ALL ".join(parts),
                      f"sp AS (SELECT module, sprint, sprint_num, count(*) AS bugs, {cnt} FROM issue "
                      f"GROUP BY module, sprint, sprint_num)")


@register("severity_series", "W22 (explicit counts, share fallback)", _sev_fixed_sql())
def q_severity_series(t):
    sp = t.issues.groupBy("module", "sprint", "sprint_num").agg(
        F.count(F.lit(1)).alias("bugs"),
        *[F.count_if(F.col("priority") == lab).alias(c) for lab, c in _SEV_COLS.items()])
    return TR.severity_counts_fixed(sp, BY, _SEV_COLS)


_OBS = {"critical": "Más alta", "high": "Alta", "medium": "Media", "low": "Baja"}


def _sev_obs_sql() -> str:
    tot = "(critical + high + medium + low)"
    shares = ", ".join(f"CASE WHEN {tot} > 0 THEN {l} / {tot} ELSE 0.25::DOUBLE END AS {l}_share" for l in _OBS)
    parts = [f"SELECT s.module, sprint, sprint_num, '{l}' AS severity, {jr(f'coalesce(bugs, 0) * {l}_share')} AS count "
             f"FROM sprint s JOIN sh ON s.module = sh.module" for l in _OBS]
    cnt = ", ".join(f"count_if(priority = '{lab}') AS {l}" for l, lab in _OBS.items())
    return sq(" UNION ALL ".join(parts),
              f"sh AS (SELECT module, {shares} FROM (SELECT module, {cnt} FROM issue GROUP BY module))")


@register("severity_counts_observed", "W21 A28", _sev_obs_sql())
def q_severity_counts_observed(t):
    iss = t.issues
    shares = iss.groupBy(*BY).agg(*[F.count_if(F.col("priority") == lab).alias(l) for l, lab in _OBS.items()])
    return TR.severity_counts_observed(sprint_frame(iss, BY), shares, BY)
