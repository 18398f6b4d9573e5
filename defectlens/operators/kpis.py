"""KPI measures K1-K38: one row per ``by`` group from ONE aggregate over the
sprint roll-up (K35: the whole KPI record in one pass, no per-KPI rescans).

Inputs come either from the issue path (the summary is the sum of the sprint
rows) or from a document (a separate summary row per group with the sprint
roll-up's column names, unioned in and picked out by conditional aggregates,
so there is no join of one-row frames).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.functions import clamp, first_truthy, fixed1, fixed2, fixed6, js_round, pct, truthy_or
from defectlens.operators.rollups import keys

_SUMMARY_FROM_SPRINT = {
    "total_bugs": "bugs", "bugs_closed": "bugs_resolved", "tc_total": "test_planned",
    "tc_executed": "test_cases", "tc_passed": "tc_passed", "production_bugs": "production_bugs",
    "rework_bugs": "reopened", "crit_all": "crit_all", "crit_cfg": "critical_total",
    "crit_pending": "crit_pending_view", "res_days_sum": "res_days_sum", "res_days_n": "res_days_n",
}


def kpi_inputs(sprints: DataFrame, by=None, summary: DataFrame | None = None) -> DataFrame:
    """Per group: sprint-level sums/moments and summary-level totals."""
    by = keys(by)
    if summary is None:
        return sprints.groupBy(*by).agg(*_input_aggs_issue_path())
    src = (sprints.withColumn("_kind", F.lit("s"))
           .unionByName(summary.withColumn("_kind", F.lit("m")), allowMissingColumns=True))
    is_s, is_m = F.col("_kind") == "s", F.col("_kind") == "m"
    return src.groupBy(*by).agg(*_input_aggs(is_s, is_m, tuple(summary.columns)))


@lru_cache(maxsize=1)
def _input_aggs_issue_path():
    """``kpi_inputs`` aggregates when the summary is the sum of the sprints."""
    t = F.lit(True)
    return _input_aggs(t, t, None)


def _input_aggs(is_s, is_m, summary_cols):
    def S(c):  # noqa: N802 - sprint-level value
        return F.when(is_s, c if isinstance(c, Column) else F.col(c))

    def M(c):  # noqa: N802 - summary-level value
        return F.coalesce(F.sum(F.when(is_m, F.col(c))), F.lit(0)).cast("long")

    cases = F.greatest(first_truthy("test_cases", "bugs"), F.lit(0))
    aggs = [
        F.count_if(is_s).alias("n"),
        F.coalesce(F.sum(S("bugs")), F.lit(0)).cast("long").alias("sum_bugs"),
        F.coalesce(F.sum(S("bugs_resolved")), F.lit(0)).cast("long").alias("sum_resolved"),
        F.coalesce(F.sum(S(cases)), F.lit(0)).cast("long").alias("sum_cases"),
        F.coalesce(F.sum(S("velocity")), F.lit(0)).cast("long").alias("sum_velocity"),
        F.coalesce(F.sum(S(first_truthy("planned_velocity", "velocity"))), F.lit(0)).cast("long")
        .alias("sum_planned"),
        F.avg(S("bugs")).alias("avg_bugs"),
        F.stddev_pop(S("bugs")).alias("std_bugs"),
        F.avg(S("velocity")).alias("avg_velocity"),
        F.stddev_pop(S("velocity")).alias("std_velocity"),
        F.min_by(S("bugs"), S("sprint_num")).alias("first_bugs"),
        F.max_by(S("bugs"), S("sprint_num")).alias("last_bugs"),
    ] + [M(src_col).alias(name) for name, src_col in _SUMMARY_FROM_SPRINT.items()]
    if summary_cols is not None and "test_automation" in summary_cols:
        aggs.append(F.max(F.when(is_m, F.col("test_automation"))).alias("test_automation"))
    return aggs


def sprint_trend(n: Column, first: Column, last: Column) -> Column:
    """``Math.round((last - first) / first * 100)``; 0 if < 2 sprints or first falsy."""
    return (F.when((n < 2) | first.isNull() | (first == 0), F.lit(0).cast("long"))
            .otherwise(js_round((last - first) / first * F.lit(100))))


def consistency(n, avg_b, std_b, avg_v, std_v) -> Column:
    """``min(1, max(0, 1 - (cv_bugs + cv_velocity) / 2))``; < 3 sprints -> 0.5."""
    cvb = F.when(avg_b > 0, std_b / avg_b).otherwise(F.lit(1.0))
    cvv = F.when(avg_v > 0, std_v / avg_v).otherwise(F.lit(1.0))
    return F.when(n < 3, F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - (cvb + cvv) / F.lit(2))))


def confidence(n, avg_b, std_b) -> Column:
    """``clamp(100 - std/mean*100, 60, 95)`` rounded; < 3 -> 60; mean 0 -> null (NaN)."""
    return (F.when(n < 3, F.lit(60).cast("long"))
            .when(avg_b > 0, js_round(F.greatest(F.lit(60.0), F.least(
                F.lit(95.0), F.lit(100.0) - std_b / avg_b * F.lit(100))))))


def kpi_record(inputs: DataFrame, by=None, cfg: C.Config | None = None) -> DataFrame:
    """K1-K22 + W1 + K19/K20 from ``kpi_inputs``.

    Built in two projections: shared intermediates (trend, consistency,
    confidence, execution rate, ...) are computed once and referenced by name,
    which keeps every expression tree small for the analyzer and codegen.
    The expressions depend only on the config and are built once per config.
    """
    cfg = cfg or C.Config()
    stage1, stage2, final, level = _kpi_exprs(cfg.key(), "test_automation" in inputs.columns)
    out = inputs.withColumns(stage1).withColumns(stage2).select(*keys(by), *final)
    return out.withColumn("maturity_level", level)


@lru_cache(maxsize=64)
def _kpi_exprs(cfg_key: str, has_automation: bool):
    cfg = C.Config.from_key(cfg_key)
    w = cfg.weights
    c = F.col
    total, closed, exe, n = c("total_bugs"), c("bugs_closed"), c("tc_executed"), c("n")
    stage1 = ({
        "_tct": truthy_or(c("tc_total"), F.lit(1)),
        "_trend": sprint_trend(n, c("first_bugs"), c("last_bugs")),
        "_cons": consistency(n, c("avg_bugs"), c("std_bugs"), c("avg_velocity"), c("std_velocity")),
        "_conf": confidence(n, c("avg_bugs"), c("std_bugs")),
        "_avgps": F.when(n > 0, js_round(c("sum_bugs") / n)).otherwise(F.lit(0).cast("long")),
        "_tot1": truthy_or(total, F.lit(1)),
    })
    stage2 = {"_exec_rate": js_round(exe / c("_tct") * F.lit(100))}
    trend, cons, conf, exec_rate, avg_bugs_ps = c("_trend"), c("_cons"), c("_conf"), c("_exec_rate"), c("_avgps")
    rr = F.when(total > 0, closed / total * F.lit(100)).otherwise(F.lit(100.0))
    cov = exe / c("_tct") * F.lit(100)
    dens = F.when(exe > 0, F.greatest(F.lit(0.0), F.lit(100) - total / exe * F.lit(50))).otherwise(F.lit(100.0))
    crit_score = F.when(total > 0, F.greatest(F.lit(0.0), F.lit(100) - c("crit_all") / total * F.lit(100))) \
        .otherwise(F.lit(100.0))
    qi_raw = (rr * F.lit(w["resolutionRate"]) + cov * F.lit(w["testCoverage"])
              + dens * F.lit(w["bugDensity"]) + crit_score * F.lit(w["criticalBugs"]))
    quality_index = js_round(clamp(qi_raw, F.lit(0), F.lit(100)))
    resolution_time = (
        F.when(c("res_days_n") > 0, js_round(c("res_days_sum") / c("res_days_n")).cast("double"))
        .when((n > 0) & (c("sum_resolved") > 0), fixed1(F.lit(C.SPRINT_DAYS) * n / c("sum_resolved")))
        .when(closed > 0, fixed1(F.greatest(n, F.lit(1)) * F.lit(C.SPRINT_DAYS) / closed))
        .otherwise(F.lit(7.0)))
    efficiency = F.when(total > 0, closed / total * F.lit(100)).otherwise(F.lit(0.0))
    automation = F.lit(float(cfg.test_automation))
    if has_automation:
        automation = F.coalesce(c("test_automation").cast("double"), automation)
    maturity = js_round((F.least(exec_rate / F.lit(20), F.lit(1.0))
                         + F.least(automation / F.lit(20), F.lit(1.0))
                         + F.least(efficiency / F.lit(20), F.lit(1.0))
                         + cons
                         + F.lit(1.0 if cfg.count_predictions_in_maturity else 0.0)) / F.lit(5) * F.lit(5))
    savings = total * F.lit(C.COST_BUG_PRODUCTION - C.COST_BUG_DEVELOPMENT)
    roi = F.when(total > 0, js_round(savings / (total * F.lit(C.COST_BUG_DEVELOPMENT)) * F.lit(100)))
    rework = truthy_or(c("rework_bugs"), js_round(total * F.lit(0.15)))
    next_bugs = js_round(avg_bugs_ps * (F.lit(1) + trend / F.lit(100)))
    q_base = F.lit(75)
    q_pred = (F.when(trend > 10, F.greatest(q_base - 5, F.lit(0)))
              .when(trend < -10, F.least(q_base + 5, F.lit(100))).otherwise(q_base)).cast("long")
    q_dir = F.when(trend > 10, "down").when(trend < -10, "up").otherwise("stable")
    final = [
        F.col("n").alias("n_sprints"),
        total.alias("total_bugs"), closed.alias("bugs_closed"), exe.alias("tc_executed"),
        c("crit_cfg").alias("critical_total"),
        (F.when(n > 0, js_round(c("sum_cases") / n)).otherwise(F.lit(0).cast("long"))).alias("avg_test_cases_per_sprint"),  # K1
        pct(closed, total).alias("resolution_efficiency"),                                    # K2
        F.when(exe > 0, fixed2(total / exe)).otherwise(F.lit(0.0)).alias("defect_density"),  # K3
        quality_index.alias("quality_index"),                                                 # K4
        trend.alias("sprint_trend"),                                                          # W1
        c("crit_all").alias("critical_count"),                                                # K6
        pct(c("crit_cfg"), total).alias("critical_ratio"),                                    # K7
        c("crit_pending").alias("critical_pending"),                                          # K8
        resolution_time.alias("avg_resolution_time"),                                         # K9
        exec_rate.alias("test_execution_rate"),                                               # K10
        js_round(c("production_bugs") / c("_tot1") * F.lit(100)).alias("leakage_rate"),      # K11
        js_round(c("production_bugs") / (c("_tot1") + c("production_bugs")) * F.lit(100))
        .alias("escape_rate"),                                                                # K12
        F.when(total > 0, js_round(rework / total * F.lit(100))).otherwise(F.lit(0).cast("long"))
        .alias("rework_rate"),                                                                # K13
        js_round(c("tc_passed") / truthy_or(exe, F.lit(1)) * F.lit(100)).alias("first_pass_yield"),  # K14
        pct(c("sum_velocity"), c("sum_planned")).alias("burndown_efficiency"),                # K15
        avg_bugs_ps.alias("avg_bugs_per_sprint"),                                             # K16
        fixed6(cons).alias("consistency"),                                                    # K17
        conf.alias("prediction_confidence"),                                                  # K18
        maturity.alias("maturity_score"),                                                     # K19
        savings.cast("long").alias("savings"), roi.alias("roi"),                              # K20
        next_bugs.alias("next_sprint_bugs"),                                                  # K21
        F.when(trend > 0, "up").otherwise("down").alias("next_sprint_trend"),
        q_pred.alias("quality_prediction"), q_dir.alias("quality_direction"),                 # K22
    ]
    level = F.lit(None).cast("string")
    for k in sorted(C.MATURITY_LEVELS):
        level = F.when(c("maturity_score") == k, F.lit(C.MATURITY_LEVELS[k])).otherwise(level)
    return stage1, stage2, final, level


def kpis(sprints: DataFrame, by=None, cfg: C.Config | None = None,
         summary: DataFrame | None = None) -> DataFrame:
    return kpi_record(kpi_inputs(sprints, by, summary), by, cfg)


def js_num_str(x: Column) -> Column:
    """JS ``String(number)`` for the values here: integral doubles lose ``.0``."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def predictions(k: DataFrame, by=None) -> DataFrame:
    """Three prediction rows per group (stack of the KPI record)."""
    by = keys(by)
    def row(o, metric, value, trend, conf):
        return F.struct(F.lit(o).alias("ord"), F.lit(metric).alias("metric"), value.alias("value"),
                        trend.alias("trend"), conf.cast("long").alias("confidence"))
    rows = F.array(
        row(1, "Bugs Próximo Sprint", F.col("next_sprint_bugs").cast("string"),
            F.col("next_sprint_trend"), F.col("prediction_confidence")),
        row(2, "Tiempo Resolución", F.concat(js_num_str(F.col("avg_resolution_time")), F.lit(" días")),
            F.lit("stable"), F.lit(85)),
        row(3, "Quality Index", F.concat(F.col("quality_prediction").cast("string"), F.lit("%")),
            F.col("quality_direction"), F.col("prediction_confidence")),
    )
    return k.select(*by, F.inline(rows))


def maturity(k: DataFrame, by=None) -> DataFrame:
    """K19 view with its label ``score/5``."""
    return k.select(*keys(by), "maturity_score", "maturity_level",
                    F.concat(F.col("maturity_score").cast("string"), F.lit("/5")).alias("maturity"),
                    "test_execution_rate", "resolution_efficiency", "consistency")


def cycle_time(sprints: DataFrame, priority: DataFrame, by=None) -> DataFrame:
    """K24 + K25: cycle-time estimate and per-priority cycle times.

    K24: the rounded mean of the sprints' own ``avg_resolution_time`` where the
    frame has such values, else ``(bugs/n) / (resolved/(n*14))`` with one
    decimal, else 14; floor 1.
    K25: per level (Más alta 5, Alta 8, Media 14, Baja 21 days):
    ``fixed1((count-resolved)/resolved*f)`` when resolved > 0, else the
    average times 0.5 / 0.8 / 1 / 1.5 (rounded except the medium level).
    ``priority`` is a ``priority_breakdown`` frame; both sides are aggregated
    to one row per group and combined by a keyed union + aggregate.
    """
    by = keys(by)
    levels = [("critical", "Más alta", 5, 0.5, True), ("high", "Alta", 8, 0.8, True),
              ("medium", "Media", 14, 1.0, False), ("low", "Baja", 21, 1.5, True)]
    real = F.col("avg_resolution_time").cast("double") if "avg_resolution_time" in sprints.columns \
        else F.lit(None).cast("double")
    s = sprints.select(*by, F.lit("s").alias("_k"), real.alias("_real"), "bugs", "bugs_resolved",
                       F.lit(None).cast("string").alias("priority"),
                       F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("resolved"))
    p = priority.select(*by, F.lit("p").alias("_k"), F.lit(None).cast("double").alias("_real"),
                        F.lit(None).cast("long").alias("bugs"),
                        F.lit(None).cast("long").alias("bugs_resolved"), "priority", "count", "resolved")
    u = s.unionByName(p)
    is_s = F.col("_k") == "s"
    aggs = [F.count_if(is_s).alias("n"), F.sum("bugs").alias("tb"), F.sum("bugs_resolved").alias("tr"), F.avg("_real").alias("real")]
    for name, lab, _f, _m, _r in levels:
        aggs.append(F.sum(F.when(F.col("priority") == lab, F.col("count"))).alias(f"{name}_c"))
        aggs.append(F.sum(F.when(F.col("priority") == lab, F.col("resolved"))).alias(f"{name}_r"))
    g = u.groupBy(*by).agg(*aggs)
    n = F.col("n")
    per_day = F.col("tr") / (n * F.lit(C.SPRINT_DAYS))
    avg = F.when(per_day > 0, fixed1((F.col("tb") / n) / per_day)).otherwise(F.lit(float(C.SPRINT_DAYS)))
    avg = F.when(F.col("real").isNotNull(), js_round(F.col("real")).cast("double")).otherwise(avg)
    g = g.filter(n > 0).withColumn("avg_ct", avg)
    cols = [F.greatest(F.col("avg_ct"), F.lit(1.0)).alias("cycle_time")]
    for name, _lab, f, m, r in levels:
        cnt = F.coalesce(F.col(f"{name}_c"), F.lit(0))
        res = F.coalesce(F.col(f"{name}_r"), F.lit(0))
        fb = js_round(F.col("avg_ct") * F.lit(m)).cast("double") if r else F.col("avg_ct")
        cols.append(F.when(res > 0, fixed1((cnt - res) / res * F.lit(f))).otherwise(fb).alias(f"{name}_days"))
    return g.select(*by, *cols)


def resolution_days(issues: DataFrame, by=None) -> DataFrame:
    """Report-to-resolution days, positive durations only (the
    sanitizer drops non-positive times): count, mean (1 decimal), max, min."""
    d = F.datediff(F.col("resolved_at"), F.col("created_at"))
    pos = F.when(d > 0, d)
    return issues.groupBy(*keys(by)).agg(
        F.count_if(d > 0).alias("n_resolved"),
        fixed1(F.avg(pos)).alias("avg_days"),
        F.max(pos).cast("long").alias("max_days"),
        F.min(pos).cast("long").alias("min_days"),
    )


def resolution_percentiles(issues: DataFrame, by=None) -> DataFrame:
    """K37 percentiles: exact p50 and p90 of the positive durations.

    ``percentile`` keeps a count per distinct number of days, so its state is
    bounded by the range of days, not by the issues."""
    d = F.datediff(F.col("resolved_at"), F.col("created_at"))
    return issues.filter(d > 0).groupBy(*keys(by)).agg(
        F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.9)).alias("p90"))


def automation_estimate(sprints: DataFrame, by=None) -> DataFrame:
    """Estimated automated tests per sprint
    ``round(cases * (0.35 + (velocity || 15) / 20 * 0.25))``, its percentage,
    the group mean percentage (``coverage``) and the last-sprint flag (the
    last sprint carries the automated / manual split)."""
    by = keys(by)
    w = Window.partitionBy(*by)
    tc = F.col("test_cases")
    auto = js_round(tc * (F.lit(0.35) + truthy_or(F.col("velocity"), F.lit(15)) / F.lit(20) * F.lit(0.25)))
    x = sprints.select(*by, "sprint", "sprint_num", "test_cases", auto.alias("auto_tests"))
    ratio = F.when(tc > 0, F.col("auto_tests") / tc * F.lit(100)).otherwise(F.lit(0.0))
    return x.select(
        *by, "sprint", "sprint_num", "test_cases", "auto_tests",
        (tc - F.col("auto_tests")).alias("manual_tests"),
        F.when(tc > 0, js_round(F.col("auto_tests") / tc * F.lit(100))).otherwise(F.lit(0).cast("long")).alias("auto_pct"),
        js_round(F.avg(ratio).over(w)).alias("coverage"),
        (F.col("sprint_num") == F.max("sprint_num").over(w)).alias("is_last"),
    )


def sprint_rollup_document(issues: DataFrame, by=None, cfg: C.Config | None = None) -> DataFrame:
    """The roll-up document's sprint rows: pending = ``To Do``, resolved =
    total - pending, estimated velocity ``round(total/7)``, planned
    ``round(total*1.2/7)``, critical and estimated critical pending
    ``round(critical/2)`` (the random columns of the dashboard are dropped)."""
    cfg = cfg or C.Config()
    g = issues.groupBy(*keys(by), "sprint", "sprint_num").agg(
        F.count(F.lit(1)).alias("bugs"),
        F.count_if(F.col("status").isin(C.PENDING_STATUS_SPRINT_VIEW)).alias("pending"),
        F.count_if(F.col("priority").isin(cfg.critical_labels)).alias("critical_total"),
    )
    return g.select(
        *keys(by), "sprint", "sprint_num", "bugs",
        (F.col("bugs") - F.col("pending")).alias("bugs_resolved"),
        F.col("pending").alias("bugs_pending"),
        js_round(F.col("bugs") / F.lit(7)).alias("velocity_est"),
        js_round(F.col("bugs") * F.lit(1.2) / F.lit(7)).alias("planned_velocity_est"),
        "critical_total",
        js_round(F.col("critical_total") / F.lit(2)).alias("critical_pending_est"),
    )


def sprints_matching(sprints: DataFrame, filtered_issues: DataFrame, sprint_terms=None) -> DataFrame:
    """Sprint rows whose label contains a requested term OR that have at
    least one issue left after filtering.  The name set is distinct sprint
    labels (bounded by the number of sprints), joined as a left lookup."""
    names = filtered_issues.select("sprint").distinct().withColumn("_hit", F.lit(True))
    cond = F.col("_hit").isNotNull()
    if sprint_terms:
        from defectlens.operators.filters import sprint_contains_any
        cond = sprint_contains_any([s.lower() for s in sprint_terms]) | cond
    return sprints.join(names, "sprint", "left").filter(cond).drop("_hit")


def legacy_kpis(inputs: DataFrame, by=None) -> DataFrame:
    """K36 (legacy KPI record) + K5 (quality index without the clamp and
    with critical = the two configured labels) + K33 (regression estimate:
    reopened / closed) + K38 (critical split: 40 % top, 60 % high)."""
    c = F.col
    total, closed, exe = c("total_bugs"), c("bugs_closed"), c("tc_executed")
    tct = truthy_or(c("tc_total"), F.lit(1))
    rr = F.when(total > 0, closed / total * F.lit(100)).otherwise(F.lit(100.0))
    cov = exe / tct * F.lit(100)
    dens = F.when(exe > 0, F.greatest(F.lit(0.0), F.lit(100) - total / exe * F.lit(50))).otherwise(F.lit(100.0))
    cs = F.when(total > 0, F.greatest(F.lit(0.0), F.lit(100) - c("crit_cfg") / total * F.lit(100))) \
        .otherwise(F.lit(100.0))
    w = C.DEFAULT_WEIGHTS
    qi = (rr * F.lit(w["resolutionRate"]) + cov * F.lit(w["testCoverage"]) + dens * F.lit(w["bugDensity"])
          + cs * F.lit(w["criticalBugs"]))
    return inputs.select(
        *keys(by),
        js_round(exe / tct * F.lit(100)).alias("test_coverage"),
        pct(closed, total).alias("resolution_efficiency"),
        js_round(qi).alias("quality_index_legacy"),
        sprint_trend(c("n"), c("first_bugs"), c("last_bugs")).alias("sprint_trend"),
        F.when(exe > 0, fixed2(total / exe)).otherwise(F.lit(0.0)).alias("defect_density"),
        pct(c("crit_cfg"), total).alias("critical_ratio"),
        F.when(closed > 0, fixed2(c("rework_bugs") / closed * F.lit(100))).otherwise(F.lit(0.0))
        .alias("regression_rate"),
        js_round(c("crit_cfg") * F.lit(0.4)).alias("critical_top"),
        js_round(c("crit_cfg") * F.lit(0.6)).alias("critical_high"),
    )


def roi_text(k: DataFrame, by=None) -> DataFrame:
    """K20 display: savings with thousands separators."""
    return k.select(*keys(by), "savings", F.format_number(F.col("savings").cast("double"), 0).alias("early_detection"),
                    "roi")
