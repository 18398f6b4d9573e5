"""Rules R1-R21: alerts, recommendation sets, status bands, the rule-table
compiler (R6) and rule overrides (J7).

Rules are data: each rule is a row (group keys, rule id, severity, text),
produced by filtering per-group metric rows, so a thousand projects give a
thousand-row alert table from one pass over the KPI record.  Rule conditions
written as text are parsed on the driver against a tiny allow-listed grammar
and compiled into ONE Spark ``CASE`` expression (one branch per rule) -- no
``eval``, no Python UDF.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.functions import fixed2, js_round, pct, truthy_or
from defectlens.operators.rollups import join_null_safe, keys
from defectlens.operators.rule_table import (DEFAULT_ICON, DEFAULT_RULES, METRIC_NAME_MAP,
                                             PRIORITY_ICONS)


def attach(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Attach one-row-per-group columns of ``right`` to ``left``: an equi-join
    on the keys, or (no keys) scalar subqueries -- never a cross join."""
    by = keys(by)
    if by:
        return join_null_safe(left, right, by)
    one = right.select(F.struct(*right.columns).alias("_s")).scalar()   # one subquery for all columns
    return left.withColumns({c: one[c] for c in right.columns})


def _rows(df: DataFrame, by, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """Emit one row per (condition, struct) candidate whose condition holds."""
    arr = F.array(*[F.when(cond, st) for cond, st in candidates])
    return df.select(*keys(by), F.explode(F.filter(arr, lambda s: s.isNotNull())).alias("_r")) \
        .select(*keys(by), "_r.*")


def first_over(df: DataFrame, by, order: list[Column]) -> DataFrame:
    """The first row per group in a stated order (``row_number() == 1``)."""
    w = Window.partitionBy(*keys(by)).orderBy(*order) if keys(by) else Window.orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _s(x) -> Column:
    return x.cast("string")


def _alert(seq, aid, typ, title, message, action, prio, area) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(aid).alias("alert_id"), lit(typ).alias("type"), lit(title).alias("title"),
                    lit(message).alias("message"), lit(action).alias("action"),
                    F.lit(prio).alias("priority"), lit(area).alias("area"), F.lit(seq).alias("_seq"))


def alerts(kpi: DataFrame, devs: DataFrame, modules: DataFrame, by=None,
           cfg: C.Config | None = None) -> DataFrame:
    """R1-R5 + O6 + O9: alerts per group, ordered by priority.

    ``kpi`` = KPI record; ``devs`` = (by, assignee, pending); ``modules`` =
    (by, module, percentage).  The overloaded developer / critical module is
    the first one by pending (share) descending, then name.  ``rank`` orders
    alerts by priority, ``shown`` marks the first three, ``overflow`` counts
    the rest (O6).
    """
    cfg = cfg or C.Config()
    th = cfg.thresholds
    by = keys(by)
    c = F.col
    k_rows = _rows(kpi, by, _kpi_alert_candidates(cfg.key()))
    return _alerts_rest(k_rows, devs, modules, by, th)


@lru_cache(maxsize=32)
def _kpi_alert_candidates(cfg_key: str):
    th = C.Config.from_key(cfg_key).thresholds
    c = F.col
    return [
        (c("critical_pending") > th["criticalBugsAlert"],
         _alert(1, "critical-bugs-high", "critical", "High Critical Bugs",
                F.concat(_s(c("critical_pending")), F.lit(" pending critical bugs require immediate attention")),
                "Review and prioritize resolution", 1, "quality-control")),
        (c("test_execution_rate") < th["minTestCoverage"],
         _alert(4, "low-test-coverage", "warning", "Low Test Coverage",
                F.concat(F.lit("Test coverage is "), _s(c("test_execution_rate")),
                         F.lit(f"%, below minimum required ({th['minTestCoverage']}%)")),
                "Increase test cases and automation", 2, "test-coverage")),
        (c("sprint_trend") > th["maxBugTrendIncrease"],
         _alert(5, "negative-trend", "warning", "Negative Bug Trend",
                F.concat(F.lit("Bugs have increased "), _s(c("sprint_trend")), F.lit("% in recent sprints")),
                "Review development and testing process", 3, "process-improvement")),
    ]


def _alerts_rest(k_rows: DataFrame, devs: DataFrame, modules: DataFrame, by, th) -> DataFrame:
    c = F.col
    dev = first_over(devs.filter(c("pending") > th["maxBugsDeveloper"]), by,
                     [F.desc("pending"), F.asc("assignee")])
    d_rows = dev.select(*by, _alert(2, "developer-overload", "warning", "Bug Concentration",
                                    F.concat(c("assignee"), F.lit(" has "), _s(c("pending")), F.lit(" pending bugs")),
                                    "Consider load redistribution", 2, "team-management").alias("_r")).select(*by, "_r.*")
    mod = first_over(modules.filter(c("percentage") > th["criticalModulePercentage"]), by,
                     [F.desc("percentage"), F.asc("module")])
    m_rows = mod.select(*by, _alert(3, F.concat(F.lit("module-critical-"), c("module")), "warning",
                                    F.concat(c("module"), F.lit(" Module Critical")),
                                    F.concat(F.lit("Module "), c("module"), F.lit(" concentrates "),
                                             _s(c("percentage")), F.lit("% of bugs")),
                                    F.concat(F.lit("Plan refactoring of "), c("module"), F.lit(" module")),
                                    2, "architecture").alias("_r")).select(*by, "_r.*")
    allr = k_rows.unionByName(d_rows).unionByName(m_rows)
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("priority", "_seq")  # stable: ties keep rule order
    n = F.count(F.lit(1)).over(Window.partitionBy(*by) if by else Window.partitionBy())
    return (allr.withColumn("rank", F.row_number().over(w))
            .withColumn("shown", c("rank") <= 3)
            .withColumn("overflow", F.greatest(n - 3, F.lit(0)).cast("long")).drop("_seq"))


def alerts_by_type(alert_rows: DataFrame, by=None) -> DataFrame:
    """Alerts per type."""
    return alert_rows.groupBy(*keys(by), "type").agg(F.count(F.lit(1)).alias("alerts"))


_IMPACT = {"high": 3, "medium": 2, "low": 1}


def recommendations(kpi: DataFrame, overload: DataFrame, by=None, cfg: C.Config | None = None) -> DataFrame:
    """R8 + O7: recommendation set A per group, ordered by impact (stable).

    ``overload`` = (by, overloaded_assignee) for groups with an overloaded
    developer (first by pending desc, then name)."""
    cfg = cfg or C.Config()
    th = cfg.thresholds
    by = keys(by)
    c = F.col
    x = attach(kpi, overload, by)
    density = c("total_bugs") / truthy_or(c("tc_executed"), F.lit(1))
    automation = F.lit(cfg.test_automation)
    if "test_automation" in kpi.columns:  # documents carry it; the issue path has none
        automation = truthy_or(c("test_automation"), automation)

    def rec(i, rid, typ, title, impact, effort, days, cat):
        return F.struct(F.lit(i).alias("seq"), F.lit(rid).alias("rec_id"), F.lit(typ).alias("type"),
                        F.lit(title).alias("title"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"),
                        F.lit(days).alias("estimated_days"), F.lit(cat).alias("category"))
    rows = _rows(x, by, [
        (c("test_execution_rate") < th["minTestCoverage"],
         rec(1, "improve-test-coverage", "quality", "Improve Test Coverage", "high", "medium", 14, "testing")),
        (c("sprint_trend") > th["maxBugTrendIncrease"],
         rec(2, "address-bug-trend", "process", "Address Bug Trend", "high", "high", 30, "process-improvement")),
        (density > th["maxDefectDensity"],
         rec(3, "reduce-defect-density", "quality", "Reduce Defect Density", "medium", "medium", 21, "code-quality")),
        (automation < 60,
         rec(4, "increase-automation", "efficiency", "Increase Automation", "high", "high", 45, "automation")),
        (c("overloaded_assignee").isNotNull(),
         rec(5, "balance-workload", "team", "Balance Workload", "medium", "low", 3, "team-management")),
    ])
    imp = F.when(c("impact") == "high", 3).when(c("impact") == "medium", 2).otherwise(1)
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(imp.desc(), c("seq"))
    return rows.withColumn("rank", F.row_number().over(w)).drop("seq")


def actionable_inputs(sprints: DataFrame, by=None) -> DataFrame:
    """Inputs of recommendation set B (K26, K27) from the sprint roll-up."""
    c = F.col
    crit = F.coalesce(F.nullif(c("c_mas_alta"), F.lit(0)), F.nullif(c("c_alta"), F.lit(0)), F.lit(0))
    g = sprints.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bugs").cast("long").alias("total"),
        F.sum("bugs_resolved").cast("long").alias("closed"),
        F.sum("test_cases").cast("long").alias("tcases"),
        F.sum(crit).cast("long").alias("crit"),
        F.sum(F.when(c("bugs") > 0, c("bugs_resolved") / c("bugs")).otherwise(F.lit(0.0))).alias("eff_sum"),
    )
    n = c("n")
    return g.select(
        *keys(by),
        F.when(c("total") > 0, js_round(c("closed") / c("total") * F.lit(100))).otherwise(F.lit(0).cast("long"))
        .alias("resolution_efficiency"),
        F.when(n > 0, js_round(c("tcases") / n)).otherwise(F.lit(0).cast("long")).alias("avg_test_cases"),
        F.when(c("total") > 0, c("crit") / c("total") * F.lit(100)).otherwise(F.lit(0.0)).alias("critical_pct"),
        js_round(F.lit(float(C.SPRINT_DAYS)) * (F.lit(1) - c("eff_sum") / truthy_or(n, F.lit(1)) * F.lit(0.5)))
        .alias("cycle_time"),                                                          # K26
        (c("total") / truthy_or(n * F.lit(6), F.lit(1))).alias("defects_per_unit"),   # K27
    )


def actionable_recommendations(inputs: DataFrame, by=None) -> DataFrame:
    """R16 + O8: recommendation set B with exclusive tiers per category,
    ordered high -> medium -> low (stable)."""
    by = keys(by)
    c = F.col
    rows = _rows(inputs, by, _actionable_candidates())
    po = F.when(c("priority") == "high", 0).when(c("priority") == "medium", 1).otherwise(2)
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(po, c("seq"))
    return rows.withColumn("rank", F.row_number().over(w)).drop("seq")


@lru_cache(maxsize=1)
def _actionable_candidates():
    c = F.col
    eff, dens, ct = c("resolution_efficiency"), c("defects_per_unit"), c("cycle_time")
    cp, tc = c("critical_pct"), c("avg_test_cases")

    def rec(i, cat, prio, title, impact, effort, value):
        return F.struct(F.lit(i).alias("seq"), F.lit(cat).alias("category"), F.lit(prio).alias("priority"),
                        F.lit(title).alias("title"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"),
                        value.cast("double").alias("value"))
    return [
        (ct > 10, rec(1, "velocity", "high", "Reduce Critical Cycle Time", "High", "Medium", ct)),
        ((ct <= 10) & (ct > 7), rec(2, "velocity", "medium", "Optimize Resolution Velocity", "Medium", "Low", ct)),
        (dens > 2.0, rec(3, "quality", "high", "Urgent Code Quality Improvement", "Very High", "High", fixed2(dens))),
        ((dens <= 2.0) & (dens > 1.0), rec(4, "quality", "medium", "Strengthen Quality Practices", "Medium", "Medium",
                                           fixed2(dens))),
        (eff < 50, rec(5, "efficiency", "high", "Improve Critical Resolution Efficiency", "Critical", "High", eff)),
        ((eff >= 50) & (eff < 70), rec(6, "efficiency", "medium", "Increase Resolution Rate", "High", "Medium", eff)),
        (cp > 30, rec(7, "critical", "high", "High Volume of Critical Bugs", "Very High", "High", cp)),
        ((cp <= 30) & (cp > 20), rec(8, "critical", "medium", "Reduce Proportion of Critical Bugs", "High", "Medium", cp)),
        (tc < 150, rec(9, "testing", "medium", "Increase Test Coverage", "High", "High", tc)),
        ((eff >= 80) & (dens <= 1.0) & (ct <= 7),
         rec(10, "excellence", "low", "Excellent Performance - Maintain Practices", "Medium", "Low", eff)),
    ]


def recommendations_by_horizon(recs: DataFrame, by=None, type_col: str = "category") -> DataFrame:
    """Recommendations grouped by type: count and the ordered titles."""
    return recs.groupBy(*keys(by), type_col).agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda s: s["title"]),
                     " | ").alias("titles"))


# ------------------------------------------------------------------ bands

def band_higher(v: Column, good, warn, labels=("success", "warning", "danger")) -> Column:
    return F.when(v.isNull(), "unknown").when(v >= good, labels[0]).when(v >= warn, labels[1]).otherwise(labels[2])


def band_lower(v: Column, good, warn, labels=("success", "warning", "danger")) -> Column:
    return F.when(v.isNull(), "unknown").when(v <= good, labels[0]).when(v <= warn, labels[1]).otherwise(labels[2])


def progress_to_target(v: Column, target, higher_better: bool) -> Column:
    """value/target (higher better) or target/value, as % clamped 0-100."""
    r = (v / F.lit(target)) if higher_better else F.when(v > 0, F.lit(target) / v).otherwise(F.lit(1.0))
    return F.when(v.isNull(), F.lit(None)).otherwise(
        js_round(F.least(F.greatest(r * F.lit(100), F.lit(0.0)), F.lit(100.0))))


# Metric cards (key, target, higher is better, good, warning).
METRIC_CARDS = [
    ("defectDensity", 0.15, False, 0.15, 0.25),
    ("testEfficiency", 85, True, 85, 70),
    ("bugLeakage", 5, False, 5, 10),
    ("testAutomation", 60, True, 60, 40),
    ("codeCoverage", 80, True, 80, 65),
    ("cycleTime", 2, False, 2, 3),
]


def metric_cards(kpi: DataFrame, by=None, automation: Column | None = None,
                 code_coverage: Column | None = None, cycle_time: Column | None = None) -> DataFrame:
    """K34 + R9 + K32: the six metric cards per group in long form (value,
    target, status band, progress to target).  Missing inputs -> null value
    -> status 'unknown'."""
    c = F.col
    dens = F.when(c("tc_executed") > 0, fixed2(c("total_bugs") / c("tc_executed")))
    vals = {
        "defectDensity": dens,
        "testEfficiency": c("test_execution_rate").cast("double"),
        "bugLeakage": c("leakage_rate").cast("double"),
        "testAutomation": automation if automation is not None else F.lit(None).cast("double"),
        "codeCoverage": code_coverage if code_coverage is not None else F.lit(None).cast("double"),
        "cycleTime": cycle_time if cycle_time is not None else c("avg_resolution_time").cast("double"),
    }
    rows = []
    for key, target, hb, good, warn in METRIC_CARDS:
        v = vals[key].cast("double")
        status = band_higher(v, good, warn) if hb else band_lower(v, good, warn)
        rows.append(F.struct(F.lit(key).alias("metric"), v.alias("value"), F.lit(float(target)).alias("target"),
                             status.alias("status"), progress_to_target(v, target, hb).cast("long").alias("progress")))
    return kpi.select(*keys(by), F.inline(F.array(*rows)))


def overview_bands(kpi: DataFrame, by=None) -> DataFrame:
    """R10 + R11 + R12 + R14 as columns of the KPI record."""
    c = F.col
    return kpi.select(
        *keys(by),
        F.when(c("avg_test_cases_per_sprint") >= 170, "success").otherwise("warning").alias("cases_band"),
        F.when(c("defect_density") * 100 <= 20, "success").when(c("defect_density") * 100 <= 30, "warning")
        .otherwise("danger").alias("density_band"),
        F.when(c("test_execution_rate") >= 95, "success").when(c("test_execution_rate") >= 80, "warning")
        .otherwise("danger").alias("execution_band"),
        F.when(c("critical_ratio") <= 20, "success").otherwise("danger").alias("critical_band"),
        F.when(c("critical_pending") <= 10, "success").otherwise("danger").alias("pending_band"),
        F.when(c("resolution_efficiency") >= 70, "success").otherwise("warning").alias("efficiency_band"),
        F.when(c("resolution_efficiency") >= 80, "Alta").when(c("resolution_efficiency") >= 60, "Media")
        .otherwise("Baja").alias("efficiency_level"),                                     # R12
        F.when(c("leakage_rate") <= 2, "Excelente").when(c("leakage_rate") <= 5, "Aceptable")
        .otherwise("Crítico").alias("leakage_level"),                                     # R14
        F.when(c("test_execution_rate") >= 95, "Excelente").when(c("test_execution_rate") >= 80, "Bueno")
        .otherwise("Crítico").alias("execution_level"),                                   # R14
    )


def module_risk(share: Column) -> Column:
    """>=60 Alto, >=40 Medio, else Bajo."""
    return F.when(share >= 60, "Alto").when(share >= 40, "Medio").otherwise("Bajo")


def developer_bands(devs: DataFrame, by=None) -> DataFrame:
    """Efficiency >=80 / >=60 and pending >15 / >10 bands per developer."""
    c = F.col
    return devs.select(*keys(by), "assignee", "efficiency", "pending",
                       F.when(c("efficiency") >= 80, "high").when(c("efficiency") >= 60, "medium")
                       .otherwise("low").alias("efficiency_band"),
                       F.when(c("pending") > 15, "overloaded").when(c("pending") > 10, "busy")
                       .otherwise("normal").alias("pending_band"))


# ------------------------------------------------------------ rule compiler

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<id>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"
                    r"|(?P<op>===|==|>=|<=|>|<|&&))")


class RuleError(ValueError):
    pass


def parse_condition(text: str):
    """Parse ``default`` or ``atom (&& atom)*`` with ``atom = field OP number``.

    Returns None for ``default`` or a list of (field, op, number).  Anything
    else (calls, strings, other operators) raises RuleError.
    """
    t = (text or "").strip()
    if t == "default":
        return None
    pos, toks = 0, []
    while pos < len(t):
        m = _TOKEN.match(t, pos)
        if not m or m.end() == pos:
            raise RuleError(f"disallowed token in rule: {t[pos:pos + 20]!r}")
        kind = m.lastgroup
        toks.append((kind, m.group(kind)))
        pos = m.end()
        while pos < len(t) and t[pos].isspace():
            pos += 1
    atoms, i = [], 0
    while True:
        if i + 2 >= len(toks):
            raise RuleError(f"incomplete rule: {t!r}")
        (k1, v1), (k2, v2), (k3, v3) = toks[i], toks[i + 1], toks[i + 2]
        if k1 != "id" or k2 != "op" or v2 == "&&" or k3 != "num":
            raise RuleError(f"rule must be 'field op number': {t!r}")
        atoms.append((v1, "==" if v2 in ("===", "==") else v2, float(v3)))
        i += 3
        if i == len(toks):
            return atoms
        if toks[i] != ("op", "&&"):
            raise RuleError(f"expected && in rule: {t!r}")
        i += 1


def field_column(field: str) -> str:
    """Metric field path -> column name (dots become ``__``)."""
    return field.replace(".", "__")


def compile_condition(text: str, available: set[str]) -> Column:
    """Rule text -> boolean Column.  Unknown fields or a rejected text give
    ``false`` (the dashboard's evaluation error -> false)."""
    try:
        atoms = parse_condition(text)
    except RuleError:
        return F.lit(False)
    if atoms is None:
        return F.lit(True)
    conds = []
    for field, op, num in atoms:
        col = field_column(field)
        if col not in available:
            return F.lit(False)
        c = F.col(col)
        conds.append({">": c > num, ">=": c >= num, "<": c < num, "<=": c <= num, "==": c == num}[op])
    return F.coalesce(reduce(lambda a, b: a & b, conds), F.lit(False))


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """The rule table as a DataFrame with a stable rule id (order kept)."""
    return spark.createDataFrame([(i, m, cnd, txt, p) for i, (m, cnd, txt, p) in enumerate(rules)],
                                 "rule_id int, metric string, condition string, text string, priority string")


def effective_rules(defaults: DataFrame, user: DataFrame | None) -> DataFrame:
    """User rules replace the defaults of every metric they mention
    (user tables may use the old or the new metric name)."""
    if user is None:
        return defaults
    # A metric's rules come from its new name if the user table has it, else from the old name.
    m, has_new = F.col("metric"), F.lit(False)
    for old, new in METRIC_NAME_MAP.items():
        m = F.when(F.col("metric") == new, F.lit(old)).otherwise(m)
        has_new = has_new | (F.col("metric") == new)
    u = user.withColumn("_new", has_new).withColumn("metric", m)
    first = u.groupBy("metric").agg(F.max("_new").alias("_any_new"))
    u = u.join(first, "metric").filter(F.col("_new") == F.col("_any_new")).drop("_new", "_any_new")
    kept = defaults.join(u.select("metric").distinct(), "metric", "left_anti")
    return kept.unionByName(u)


def evaluate_rules(metrics: DataFrame, rules: list[tuple], by=None) -> DataFrame:
    """R6 + J6 + R7: metric rows x rules -> the recommendations whose
    condition holds.

    ``metrics`` has one row per (group, metric) with one column per field
    (``byPriority.critical`` -> ``byPriority__critical``).  ``rules`` is a
    driver-side list (metric, condition, text, priority) -- the rule table is
    code-sized, so it is broadcast and each rule's condition is compiled into
    a branch of one CASE keyed on the rule id.
    """
    by = keys(by)
    spark = metrics.sparkSession
    rules = tuple(tuple(r) for r in rules)
    check, icon, bold = _rule_exprs(rules, tuple(sorted(metrics.columns)))
    rf = rules_frame(spark, list(rules))
    j = metrics.join(F.broadcast(rf), "metric", "inner").filter(check)
    return j.select(*by, "metric", "rule_id", "text", F.coalesce(F.col("priority"), F.lit("media")).alias("priority"),
                    icon.alias("icon"), bold.alias("emphasis"))


@lru_cache(maxsize=32)
def _rule_exprs(rules: tuple, columns: tuple):
    """The compiled rule CASE, icon and emphasis expressions (built once per
    rule table and metric schema)."""
    avail = set(columns)
    check = None
    for i, (_m, cond, _t, _p) in enumerate(rules):
        br = compile_condition(cond, avail)
        check = F.when(F.col("rule_id") == i, br) if check is None else check.when(F.col("rule_id") == i, br)
    check = check.otherwise(F.lit(False))
    pr = F.lower(F.col("priority"))
    icon = F.lit(DEFAULT_ICON)
    for p, ic in reversed(list(PRIORITY_ICONS.items())):
        icon = F.when(pr == p, F.lit(ic)).otherwise(icon)
    bold = F.when(F.col("text").contains(":"), F.split_part(F.col("text"), F.lit(":"), F.lit(1))).otherwise(F.lit(""))
    return check, icon, bold


def metric_fields(kpi: DataFrame, cycle: DataFrame, by=None) -> DataFrame:
    """Per-group metric rows for the default rule table:
    testCases.avg = K1, resolutionEfficiency.efficiency = K2,
    criticalBugs.total = critical count (configured labels),
    criticalBugsStatus.pending = K8, cycleTime.avg = K24 and
    byPriority.critical = K25, defectDensity.avg = K3 and critical =
    critical share of bugs (ratio)."""
    by = keys(by)
    x = attach(kpi, cycle, by)
    c = F.col
    null = F.lit(None).cast("double")

    def row(metric, **fields):
        names = ["avg", "efficiency", "total", "pending", "byPriority__critical", "critical"]
        return F.struct(F.lit(metric).alias("metric"),
                        *[(fields[n].cast("double") if n in fields else null).alias(n) for n in names])
    crit_share = F.when(c("total_bugs") > 0, c("critical_total") / c("total_bugs")).otherwise(F.lit(0.0))
    arr = F.array(
        row("testCases", avg=c("avg_test_cases_per_sprint")),
        row("resolutionEfficiency", efficiency=c("resolution_efficiency")),
        row("criticalBugs", total=c("critical_total")),
        row("criticalBugsStatus", pending=c("critical_pending")),
        row("cycleTime", avg=c("cycle_time"), byPriority__critical=c("critical_days")),
        row("defectDensity", avg=c("defect_density"), critical=crit_share),
    )
    return x.select(*by, F.inline(arr))


def risk_areas(issues: DataFrame, areas: list[str], by=None, impact: str = "Crítico") -> DataFrame:
    """R20 + J5: named modules with their issue count (0 when absent): one
    conditional count per configured area, then one row per area."""
    by = keys(by)
    wide = issues.groupBy(*by).agg(*[F.count_if(F.col("module") == a).alias(f"a{i}") for i, a in enumerate(areas)])
    arr = F.array(*[F.struct(F.lit(a).alias("area"), F.col(f"a{i}").alias("bugs"), F.lit(impact).alias("impact"))
                    for i, a in enumerate(areas)])
    return wide.select(*by, F.inline(arr))


def module_thresholds(modules: DataFrame, cfg: C.Config | None = None, default_weight: float = 0.0,
                      default_threshold: float = 100.0) -> DataFrame:
    """Per-module weight and critical threshold from config (broadcast
    code-sized dimension, left join, default for unconfigured modules); flag
    modules whose share exceeds their threshold."""
    cfg = cfg or C.Config()
    spark = modules.sparkSession
    dim = spark.createDataFrame([(k, float(v["weight"]), float(v["criticalThreshold"])) for k, v in cfg.modules.items()],
                                "module string, weight double, critical_threshold double")
    x = modules.join(F.broadcast(dim), "module", "left")
    th = F.coalesce(F.col("critical_threshold"), F.lit(default_threshold))
    return x.select("*").withColumn("weight", F.coalesce(F.col("weight"), F.lit(default_weight))) \
        .withColumn("critical_threshold", th).withColumn("over_threshold", F.col("percentage") > th)


def team_findings(devs: DataFrame, by=None, threshold: int = 15) -> DataFrame:
    """Per group, the most loaded developer (pending desc, then name)
    and whether it exceeds the threshold, how many developers have a low
    workload, and the overall efficiency.  ``devs``: assignee, assigned,
    resolved, pending, workload."""
    by = keys(by)
    c = F.col
    g = devs.groupBy(*by).agg(
        F.count_if(F.lower(F.coalesce(c("workload"), F.lit(""))).contains("bajo")).alias("low_load_developers"),
        pct(F.sum("resolved"), F.sum("assigned")).alias("overall_efficiency"),
    )
    top = first_over(devs, by, [F.desc("pending"), F.asc("assignee")]).select(
        *by, c("assignee").alias("top_assignee"), c("pending").alias("top_pending"))
    out = attach(g, top, by)
    return out.withColumn("overloaded", F.coalesce(c("top_pending") > threshold, F.lit(False)))


def module_findings(modules: DataFrame, by=None, critical_pct: int = 60, good_rate: float = 0.8) -> DataFrame:
    """Per group, the critical module (first with share >= 60 %, by
    share desc then name) and the modules resolving >= 80 % of their issues
    (names joined by ', ' in name order; bounded by the module count).
    ``modules``: module, total, resolved, percentage."""
    by = keys(by)
    c = F.col
    crit = first_over(modules.filter(c("percentage") >= critical_pct), by,
                      [F.desc("percentage"), F.asc("module")]).select(
        *by, c("module").alias("critical_module"), c("percentage").alias("critical_percentage"))
    good = (c("total") > 0) & (c("resolved") / c("total") >= good_rate)
    g = modules.groupBy(*by).agg(
        F.count(F.lit(1)).alias("modules"),
        F.array_join(F.array_sort(F.collect_list(F.when(good, c("module")))), ", ").alias("high_resolution_modules"),
    )
    return attach(g, crit, by)


def legacy_alerts(priority: DataFrame, devs: DataFrame, modules: DataFrame, by=None,
                  labels=("Más alta", "Alta"), module_label: str = "POS") -> DataFrame:
    """Critical pending (two labels) > 20, the developer with the
    largest pending (> 15; first by name on ties), a named module's share
    > 60.  ``priority``: priority, pending; ``devs``: assignee, pending;
    ``modules``: module, percentage."""
    by = keys(by)
    c = F.col
    cp = priority.filter(c("priority").isin(list(labels))).groupBy(*by).agg(
        F.sum("pending").cast("long").alias("v"))
    a1 = cp.filter(c("v") > 20).select(*by, F.lit("critical").alias("type"),
                                       F.lit("Bugs Críticos Elevados").alias("title"),
                                       F.concat(c("v").cast("string"),
                                                F.lit(" bugs críticos pendientes requieren atención inmediata"))
                                       .alias("message"))
    top = first_over(devs, by, [F.desc("pending"), F.asc("assignee")]).filter(c("pending") > 15)
    a2 = top.select(*by, F.lit("warning").alias("type"), F.lit("Concentración de Bugs").alias("title"),
                    F.concat(c("assignee"), F.lit(" tiene "), c("pending").cast("string"),
                             F.lit(" bugs pendientes")).alias("message"))
    m = modules.filter((c("module") == module_label) & (c("percentage") > 60))
    a3 = m.select(*by, F.lit("warning").alias("type"), F.lit(f"Módulo {module_label} Crítico").alias("title"),
                  F.concat(F.lit(f"El módulo {module_label} concentra "), c("percentage").cast("string"),
                           F.lit("% de los bugs")).alias("message"))
    return a1.unionByName(a2).unionByName(a3)
