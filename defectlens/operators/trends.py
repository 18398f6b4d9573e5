"""Window and trend operators W1-W24 over the sprint roll-up.

All windows are ``partitionBy(by)`` and ordered by ``sprint_num`` (then the
label), so each task holds one group's sprints (tens to hundreds of rows);
nothing here touches the issue table.  Whole-partition frames use
``Window.partitionBy(by)`` with no order, "one row back" uses ``lag``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlens.functions import clamp, first_truthy, fixed1, fixed2, js_round, pct, truthy_or
from defectlens.operators.rollups import keys


def _w(by, order=True):
    w = Window.partitionBy(*keys(by)) if keys(by) else Window.partitionBy()
    return w.orderBy("sprint_num", "sprint") if order else w


def sprint_label(by=None) -> Column:
    """``sprint || 'Sprint ' + (index + 1)``."""
    return F.coalesce(F.nullif(F.col("sprint"), F.lit("")),
                      F.concat(F.lit("Sprint "), F.row_number().over(_w(by)).cast("string")))


def resolution_rate(resolved: Column, pending: Column) -> Column:
    """``pct(resolved, resolved + pending)``."""
    return pct(resolved, resolved + pending)


def quality_score(bugs: Column, cases: Column, resolved: Column) -> Column:
    """``clamp(100 - 2 bugs + min(cases/10, 20) + resolved/(bugs||1)*10)``."""
    bonus = F.when(F.coalesce(resolved, F.lit(0)) != 0,
                   resolved / truthy_or(bugs, F.lit(1)) * F.lit(10)).otherwise(F.lit(0.0))
    q = (F.lit(100) - F.coalesce(bugs, F.lit(0)) * F.lit(2)
         + F.least(F.coalesce(cases, F.lit(0)) / F.lit(10), F.lit(20.0)) + bonus)
    return js_round(clamp(q, F.lit(0.0), F.lit(100.0)))


def sprint_trends(sprints: DataFrame, by=None) -> DataFrame:
    """W23 bundle (W2, W3, W4, W5, W7, W8) as one windowed select."""
    by = keys(by)
    c = F.col
    planned = first_truthy("planned_velocity", "velocity")
    extra = [F.coalesce(c("change"), F.lit(0)).cast("long").alias("change")] if "change" in sprints.columns else []
    return sprints.select(
        *by, sprint_label(by).alias("sprint"), "sprint_num",
        c("bugs"), *extra, c("bugs_resolved").alias("resolved"), c("bugs_pending").alias("pending"),
        resolution_rate(c("bugs_resolved"), c("bugs_pending")).alias("resolution_rate"),   # W3
        quality_score(c("bugs"), c("test_cases"), c("bugs_resolved")).alias("quality"),    # W4
        c("velocity"), planned.alias("planned"),                                          # W5
        F.when(c("planned_velocity") > 0, js_round(c("velocity") / c("planned_velocity") * F.lit(100)))
        .otherwise(F.lit(100).cast("long")).alias("velocity_efficiency"),
        F.when(c("test_cases") != 0, F.least(c("test_cases") / F.lit(100) * F.lit(100), F.lit(100.0)))
        .otherwise(F.lit(0.0)).alias("coverage"),                                         # W7
        F.when(c("test_cases") > 0, fixed2(c("bugs") / c("test_cases"))).otherwise(F.lit(0.0))
        .alias("density"),                                                                # W8
    )


def velocity_change(sprints: DataFrame, by=None) -> DataFrame:
    """% change of velocity vs the previous sprint (first row 0); groups
    with fewer than two sprints give no rows."""
    by = keys(by)
    w = _w(by)
    prev = F.coalesce(F.lag("velocity").over(w), F.col("velocity"))
    n = F.count(F.lit(1)).over(_w(by, order=False))
    x = sprints.select(*by, "sprint", "sprint_num", "velocity", prev.alias("_prev"), n.alias("_n"))
    ch = F.when(F.col("_prev") > 0, js_round((F.col("velocity") - F.col("_prev")) / F.col("_prev") * F.lit(100))) \
        .otherwise(F.lit(0).cast("long"))
    return x.filter(F.col("_n") >= 2).select(*by, "sprint", "sprint_num", "velocity", ch.alias("change"))


def density_band_ratio(d: Column) -> Column:
    """Density as a ratio: <=.1 Excelente, <=.3 Bueno, <=.5 Alerta, else Crítico."""
    return (F.when(d <= 0.1, "Excelente").when(d <= 0.3, "Bueno").when(d <= 0.5, "Alerta")
            .otherwise("Crítico"))


def density_band_pct(d: Column) -> Column:
    """Density per sprint in %: <=15, <=25, <=35, more."""
    return (F.when(d <= 15, "Excelente").when(d <= 25, "Bueno").when(d <= 35, "Aceptable")
            .otherwise("Crítico"))


def density_series(sprints: DataFrame, by=None) -> DataFrame:
    """W8 + R13 + R15: density per sprint with both bandings."""
    c = F.col
    dens = F.when(c("test_cases") > 0, fixed2(c("bugs") / c("test_cases"))).otherwise(F.lit(0.0))
    return sprints.select(*keys(by), "sprint", "sprint_num", "bugs", "test_cases", dens.alias("density")) \
        .withColumn("band", density_band_ratio(c("density"))) \
        .withColumn("band_pct", density_band_pct(c("density") * F.lit(100)))


def first_last_change(sprints: DataFrame, by=None, value: str = "bugs") -> DataFrame:
    """W1 + W16 per group: first and last value by sprint order, the KPI trend
    (0 if < 2 sprints or first falsy) and the sparkline change
    ``round((last - first) / (abs(first) || 1) * 100)`` (null if < 2)."""
    by = keys(by)
    order = F.struct(F.col("sprint_num"), F.col("sprint"))
    g = sprints.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sprints"),
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
    )
    n, f, last = F.col("n_sprints"), F.col("first_value"), F.col("last_value")
    trend = F.when((n < 2) | (f == 0), F.lit(0).cast("long")).otherwise(js_round((last - f) / f * F.lit(100)))
    change = F.when(n >= 2, js_round((last - f) / truthy_or(F.abs(f), F.lit(1)) * F.lit(100)))
    return g.select(*by, "n_sprints", "first_value", "last_value", trend.alias("trend"), change.alias("series_change"))


def half_split(sprints: DataFrame, metrics: dict[str, Column], by=None) -> DataFrame:
    """Per group and metric, mean of the first floor(n/2) sprints vs the
    mean of the rest, ``round((second - first) / first * 100)``; 0 if < 2
    sprints or first mean 0.  One window pass numbers the rows, one aggregate
    computes every metric's two means."""
    by = keys(by)
    x = sprints.select(*by, *[v.alias(k) for k, v in metrics.items()],
                       F.row_number().over(_w(by)).alias("_rn"),
                       F.count(F.lit(1)).over(_w(by, order=False)).alias("_n"))
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    aggs = [F.max("_n").alias("n_sprints")]
    for k in metrics:
        aggs += [F.avg(F.when(first, F.col(k))).alias(f"{k}__a"), F.avg(F.when(~first, F.col(k))).alias(f"{k}__b")]
    g = x.groupBy(*by).agg(*aggs)
    out = []
    for k in metrics:
        a, b = F.col(f"{k}__a"), F.col(f"{k}__b")
        out.append(F.when((F.col("n_sprints") < 2) | a.isNull() | (a == 0), F.lit(0).cast("long"))
                   .otherwise(js_round((b - a) / a * F.lit(100))).alias(k))
    return g.select(*by, "n_sprints", *out)


def half_split_trends(sprints: DataFrame, by=None) -> DataFrame:
    """The four dashboard trends (cases, resolution rate, bugs with the
    sign inverted, execution rate)."""
    c = F.col
    planned = first_truthy("test_planned", "test_cases")
    m = {
        "test_cases_trend": F.coalesce(c("test_cases"), F.lit(0)),
        "resolution_trend": F.when(c("bugs") > 0, c("bugs_resolved") / c("bugs") * F.lit(100)).otherwise(F.lit(0.0)),
        "critical_bugs_trend": F.coalesce(c("bugs"), F.lit(0)),
        "execution_trend": F.when(planned > 0, js_round(c("test_cases") / planned * F.lit(100)))
        .otherwise(F.lit(0).cast("long")),
    }
    hs = half_split(sprints, m, by)
    return hs.withColumn("critical_bugs_trend", -F.col("critical_bugs_trend"))


# Comparison metrics (name, inverse = lower is better).
COMPARISON_METRICS = [("bugs", True), ("bugs_resolved", False), ("test_cases", False),
                      ("resolution_rate", False), ("critical_bugs", True)]


def comparison_long(sprints: DataFrame, by=None) -> DataFrame:
    """The comparison metrics per sprint in long form (metric, value)."""
    return sprints.select(*keys(by), "sprint", "sprint_num", F.inline(_comparison_array()))


@lru_cache(maxsize=1)
def _comparison_array() -> Column:
    c = F.col
    vals = {
        "bugs": c("bugs"), "bugs_resolved": c("bugs_resolved"), "test_cases": c("test_cases"),
        "resolution_rate": pct(c("bugs_resolved"), c("bugs")), "critical_bugs": c("critical_total"),
    }
    return F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(inv).alias("inverse"),
                              vals[k].cast("long").alias("value")) for k, inv in COMPARISON_METRICS])


def sprint_comparison(sprints: DataFrame, by=None) -> DataFrame:
    """W11 + W24: last two sprints per group and metric: previous, current,
    mean of all sprints (1 decimal), delta, delta %, delta vs mean (1
    decimal) and its %, direction (inverse metrics: lower is better)."""
    by = keys(by)
    long = comparison_long(sprints, by)
    w = Window.partitionBy(*by, "metric").orderBy(F.desc("sprint_num"), F.desc("sprint"))
    x = long.withColumn("_rk", F.row_number().over(w))
    g = x.groupBy(*by, "metric", "inverse").agg(
        F.count(F.lit(1)).alias("n_sprints"),
        F.max(F.when(F.col("_rk") == 2, F.col("value"))).alias("previous"),
        F.max(F.when(F.col("_rk") == 1, F.col("value"))).alias("current"),
        fixed1(F.avg("value")).alias("mean"),
    ).filter(F.col("n_sprints") >= 2)
    c = F.col
    delta = c("current") - c("previous")
    dm = fixed1(c("current") - c("mean"))
    better = F.when(c("inverse"), delta < 0).otherwise(delta > 0)
    better_m = F.when(c("inverse"), dm < 0).otherwise(dm > 0)
    return g.select(
        *by, "metric", "previous", "current", "mean",
        delta.alias("delta"),
        F.when(c("previous") != 0, js_round(delta / c("previous") * F.lit(100))).otherwise(F.lit(0).cast("long"))
        .alias("delta_pct"),
        dm.alias("delta_mean"),
        F.when(c("mean") != 0, js_round(dm / c("mean") * F.lit(100))).otherwise(F.lit(0).cast("long"))
        .alias("delta_mean_pct"),
        F.when(delta == 0, "same").when(better, "better").otherwise("worse").alias("direction"),
        F.when(dm == 0, "same").when(better_m, "better").otherwise("worse").alias("direction_mean"),
    )


def comparison_findings(comparison: DataFrame, by=None) -> DataFrame:
    """Finding rows from the last-two comparison of bugs, resolved and
    resolution rate.  Percentages are null where the previous value is 0."""
    by = keys(by)
    c = F.col
    d, p = c("delta"), c("previous")
    pc = F.when(p != 0, js_round(d / p * F.lit(100)))
    rules = [
        ("bugs", d < 0, "Total Bugs Reduction", F.abs(d), F.abs(pc)),
        ("bugs", d > 0, "Increase in Bugs", d, pc),
        ("bugs_resolved", d > 0, "Resolution Improvement", d, pc),
        ("resolution_rate", d > 0, "Resolution Rate Improvement", d, F.lit(None).cast("long")),
        ("resolution_rate", d < 0, "Resolution Rate Reduction", F.abs(d), F.lit(None).cast("long")),
    ]
    arr = F.array(*[F.when((c("metric") == m) & cond,
                           F.struct(F.lit(t).alias("finding"), amount.cast("long").alias("amount"),
                                    pct_.cast("long").alias("amount_pct")))
                    for m, cond, t, amount, pct_ in rules])
    return (comparison.select(*by, F.explode(F.filter(arr, lambda s: s.isNotNull())).alias("f"))
            .select(*by, "f.*"))


def metric_series(sprints: DataFrame, by=None) -> DataFrame:
    """W14 + W15: per sprint, the sparkline metrics in long form."""
    return sprints.select(*keys(by), "sprint", "sprint_num", F.inline(_metric_series_array()))


@lru_cache(maxsize=1)
def _metric_series_array() -> Column:
    c = F.col
    planned = first_truthy("test_planned", "test_cases")
    eff = F.when(c("bugs") > 0, js_round(c("bugs_resolved") / c("bugs") * F.lit(100)))
    auto = js_round(c("test_cases") * (F.lit(0.35) + truthy_or(c("velocity"), F.lit(15)) / F.lit(20) * F.lit(0.25)))
    res_time = F.when(c("res_days_n") > 0, js_round(c("res_days_sum") / c("res_days_n"))).otherwise(F.lit(0))
    vals = [
        ("execution_rate", F.when(planned > 0, js_round(c("test_cases") / planned * F.lit(100))).otherwise(F.lit(0))),
        ("test_cases", F.coalesce(c("test_cases"), F.lit(0))),
        ("resolution_efficiency", F.coalesce(eff, F.lit(0))),
        ("automation_coverage", F.when(c("test_cases") > 0, js_round(auto / c("test_cases") * F.lit(100)))
         .otherwise(F.lit(0))),
        ("critical_bugs", c("critical_total")),
        ("critical_bugs_pending", c("critical_pending")),
        ("cycle_time", js_round(F.lit(15) - truthy_or(eff, F.lit(70)) / F.lit(10))),
        ("bugs", c("bugs")),
        ("defect_density", F.when(c("test_cases") > 0, fixed2(c("bugs") / c("test_cases"))).otherwise(F.lit(0.0))),
        ("test_efficiency", F.when(planned > 0, js_round(c("test_cases") / planned * F.lit(100))).otherwise(F.lit(0))),
        ("bug_leakage", js_round(c("production_bugs") / truthy_or(c("bugs"), F.lit(1)) * F.lit(100))),
        ("resolution_time", res_time),
    ]
    return F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in vals])


def series_change(series: DataFrame, by=None) -> DataFrame:
    """W16 per (group, metric) of a long metric series."""
    return first_last_change(series, keys(by) + ["metric"], value="value")


def executed_vs_planned(sprints: DataFrame, by=None) -> DataFrame:
    """Executed and planned cases per sprint with the execution %."""
    c = F.col
    return sprints.select(*keys(by), "sprint", "sprint_num", c("test_cases").alias("executed"),
                          c("test_planned").alias("planned"),
                          pct(c("test_cases"), c("test_planned")).alias("execution_pct"))


# Per-priority resolution-time model (level, base, complexity
# factor, rate factor, min, max, target days).
RESOLUTION_LEVELS = [
    ("Critical", 3, 1.0, 2.0, 2, 5, 3),
    ("High", 5, 1.0, 1.5, 4, 8, 5),
    ("Medium", 8, 1.5, 1.0, 6, 12, 7),
    ("Low", 12, 2.0, 0.5, 10, 18, 10),
]


def priority_resolution_series(sprints: DataFrame, by=None) -> DataFrame:
    """W18 + W19: estimated resolution days per sprint and priority level,
    ``clamp(round(base + f*bugs/(velocity||1) - g*resolved/(bugs||1)))``,
    with the level target, whether it is met and the gap."""
    c = F.col
    x = sprints.select(*keys(by), "sprint", "sprint_num", F.inline(_resolution_rows()))
    return x.withColumn("meets_target", c("days") <= c("target")).withColumn("gap", c("days") - c("target"))


@lru_cache(maxsize=1)
def _resolution_rows() -> Column:
    c = F.col
    rate = c("bugs_resolved") / truthy_or(c("bugs"), F.lit(1))
    cx = c("bugs") / truthy_or(c("velocity"), F.lit(1))
    rows = []
    for lvl, base, f, g, lo, hi, target in RESOLUTION_LEVELS:
        cxf = cx if f == 1.0 else cx * F.lit(f)
        days = F.greatest(F.lit(lo), F.least(F.lit(hi), js_round(F.lit(base) + cxf - rate * F.lit(g))))
        rows.append(F.struct(F.lit(lvl).alias("level"), days.cast("long").alias("days"),
                             F.lit(target).cast("long").alias("target")))
    return F.array(*rows)


# Fixed severity shares of a sprint's bugs.
SEVERITY_SHARES = [("Más alta", 0.05), ("Alta", 0.30), ("Media", 0.55), ("Baja", 0.08), ("Más baja", 0.02)]


def severity_efficiency(sprints: DataFrame, by=None) -> DataFrame:
    """Bugs split by fixed shares, resolved in proportion, efficiency %."""
    return sprints.select(*keys(by), "sprint", "sprint_num", F.inline(_severity_rows()))


@lru_cache(maxsize=1)
def _severity_rows() -> Column:
    c = F.col
    ratio = c("bugs_resolved") / truthy_or(c("bugs"), F.lit(1))
    rows = []
    for lab, share in SEVERITY_SHARES:
        tot = js_round(F.coalesce(c("bugs"), F.lit(0)) * F.lit(share))
        res = js_round(tot * ratio)
        rows.append(F.struct(F.lit(lab).alias("severity"), tot.alias("total"), res.alias("resolved"),
                             F.when(tot > 0, js_round(res / tot * F.lit(100))).otherwise(F.lit(0).cast("long"))
                             .alias("efficiency")))
    return F.array(*rows)


def severity_counts_fixed(sprints: DataFrame, by=None, count_cols: dict[str, str] | None = None) -> DataFrame:
    """Per sprint and severity, the explicit count column if present,
    else ``round(bugs * share)``."""
    count_cols = count_cols or {}
    c = F.col
    rows = []
    for lab, share in SEVERITY_SHARES:
        est = js_round(F.coalesce(c("bugs"), F.lit(0)) * F.lit(share))
        val = F.coalesce(c(count_cols[lab]).cast("long"), est) if lab in count_cols else est
        rows.append(F.struct(F.lit(lab).alias("severity"), val.alias("count")))
    return sprints.select(*keys(by), "sprint", "sprint_num", F.inline(F.array(*rows)))


def severity_counts_observed(sprints: DataFrame, shares: DataFrame, by=None) -> DataFrame:
    """Per sprint, ``round(bugs * share)`` with the group's observed
    critical/high/medium/low shares (25 % each if the group has none).
    ``shares``: one row per group with columns critical, high, medium, low."""
    by = keys(by)
    c = F.col
    tot = c("critical") + c("high") + c("medium") + c("low")
    levels = ["critical", "high", "medium", "low"]
    sh = shares.select(*by, *[F.when(tot > 0, c(l) / tot).otherwise(F.lit(0.25)).alias(f"{l}_share")
                              for l in levels])
    if by:
        x = sprints.join(sh, by, "inner")
    else:
        one = sh.select(F.struct(*[f"{l}_share" for l in levels]).alias("_s")).scalar()
        x = sprints.withColumns({f"{l}_share": one[f"{l}_share"] for l in levels})
    rows = [F.struct(F.lit(l).alias("severity"), js_round(F.coalesce(c("bugs"), F.lit(0)) * c(f"{l}_share"))
                     .alias("count")) for l in levels]
    return x.select(*by, "sprint", "sprint_num", F.inline(F.array(*rows)))
