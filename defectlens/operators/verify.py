"""Verification and data quality: reconciliation of two sources (J1,
V1-V4), structural validation (V5), sanitizing (N7), snapshot diff (V7).

Both sources are first aggregated to one row per sprint (partial aggregation
before the shuffle), so the reconciliation join is between two sprint-sized
frames; a full outer join exposes sprints missing on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlens.functions import js_round
from defectlens.operators.rollups import keys


def sprint_counts(df: DataFrame, critical: Column, pending: Column, by=None) -> DataFrame:
    """Per sprint: total, critical and pending rows of one source."""
    return df.groupBy(*keys(by), "sprint_num").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(critical).alias("critical"), F.count_if(pending).alias("pending"))


def reconcile_sprints(a: DataFrame, b: DataFrame, by=None) -> DataFrame:
    """J1 + V2: per sprint number, the two sources side by side and the
    three match flags (null-safe equality; a sprint missing on one side
    does not match)."""
    by = keys(by)
    ja = a.select(*by, "sprint_num", *[F.col(c).alias(f"{c}_a") for c in ("total", "critical", "pending")])
    jb = b.select(*by, "sprint_num", *[F.col(c).alias(f"{c}_b") for c in ("total", "critical", "pending")])
    j = ja.join(jb, by + ["sprint_num"], "full_outer")
    flags = {f"{c}_match": F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in ("total", "critical", "pending")}
    j = j.withColumns(flags)
    return j.withColumn("in_both", F.col("total_a").isNotNull() & F.col("total_b").isNotNull()) \
        .withColumn("all_match", F.col("total_match") & F.col("critical_match") & F.col("pending_match"))


def reconciliation_summary(rec: DataFrame, by=None) -> DataFrame:
    """V1 + V3 + V4: totals and sprint counts of each source, equality flags,
    match percentage over sprints present in both, status (> 80 -> success)
    and the verification messages -- one aggregate over the reconciled rows."""
    by = keys(by)
    g = rec.groupBy(*by).agg(
        F.coalesce(F.sum("total_a"), F.lit(0)).cast("long").alias("total_a"),
        F.coalesce(F.sum("total_b"), F.lit(0)).cast("long").alias("total_b"),
        F.count("total_a").alias("sprints_a"),
        F.count("total_b").alias("sprints_b"),
        F.count_if(F.col("in_both")).alias("compared"),
        F.count_if(F.col("in_both") & F.col("all_match")).alias("matched"),
    )
    c = F.col
    pct = F.when(c("compared") > 0, js_round(c("matched") / c("compared") * F.lit(100))).otherwise(F.lit(100).cast("long"))
    g = g.select(*by, "total_a", "total_b", "sprints_a", "sprints_b", "compared", "matched",
                 (c("total_a") == c("total_b")).alias("totals_match"),
                 (c("sprints_a") == c("sprints_b")).alias("sprints_match"), pct.alias("match_percentage"))
    msgs = F.array(
        F.when(c("totals_match"), F.lit("Total bugs matches")).otherwise(
            F.concat(F.lit("Total bugs different: A="), c("total_a").cast("string"), F.lit(", B="),
                     c("total_b").cast("string"))),
        F.when(c("sprints_match"), F.lit("Number of sprints matches")).otherwise(
            F.concat(F.lit("Number of sprints different: A="), c("sprints_a").cast("string"), F.lit(", B="),
                     c("sprints_b").cast("string"))),
        F.when(c("match_percentage") == 100, F.lit("All sprints match 100%")).otherwise(
            F.concat(F.lit("Only "), c("match_percentage").cast("string"), F.lit("% of sprints match completely"))),
    )
    return g.withColumn("status", F.when(c("match_percentage") > 80, "success").otherwise("warning")) \
        .withColumn("messages", F.array_join(msgs, " | "))


def validate_sprint_rows(sprints: DataFrame, by=None) -> DataFrame:
    """V5 at row level: the list of problems of each sprint row
    (``array_compact`` of conditional messages) and ``is_valid``."""
    c = F.col
    checks = [
        (c("sprint").isNull() | (F.trim(c("sprint")) == ""), "missing sprint label"),
        (c("sprint_num").isNull(), "missing sprint number"),
        (c("bugs").isNull() | (c("bugs") < 0), "invalid bugs"),
        (c("bugs_resolved") > c("bugs"), "resolved exceeds bugs"),
        (c("bugs_pending") < 0, "negative pending"),
        (c("bugs_resolved") + c("bugs_pending") != c("bugs"), "resolved + pending != bugs"),
        (c("test_cases") < 0, "negative executed cases"),
        (c("test_cases") > c("test_planned"), "executed exceeds planned"),
        (c("critical_pending") > c("critical_total"), "critical pending exceeds critical"),
    ]
    errs = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))
    return sprints.select(*keys(by), "sprint", "sprint_num", errs.alias("_e")).select(
        *keys(by), "sprint", "sprint_num", (F.size("_e") == 0).alias("is_valid"),
        F.size("_e").alias("n_errors"), F.array_join("_e", "; ").alias("errors"))


def validate_document(docs: DataFrame, key: str = "doc_path") -> DataFrame:
    """V5 at document level: summary present with numeric totalBugs and
    testCasesTotal, sprintData and developerData arrays present; one row per
    document with its error list and ``is_valid``."""
    c = F.col
    fields = set(docs.columns)

    def missing(name):
        return c(name).isNull() if name in fields else F.lit(True)

    def missing_in_summary(name):
        return (c("summary").isNotNull() & c(f"summary.{name}").isNull()) if "summary" in fields else F.lit(False)
    checks = [
        (missing("summary"), "Missing summary data"),
        (missing_in_summary("totalBugs"), "Invalid totalBugs in summary"),
        (missing_in_summary("testCasesTotal"), "Invalid testCasesTotal in summary"),
        (missing("sprintData"), "SprintData should be an array"),
        (missing("developerData"), "DeveloperData should be an array"),
    ]
    errs = F.array_compact(F.array(*[F.when(cond, F.lit(m)) for cond, m in checks]))
    return docs.select(key, errs.alias("errors")).withColumn("is_valid", F.size("errors") == 0)


def sanitize_sprints(sprints: DataFrame) -> DataFrame:
    """N7 for sprint rows: counts clamped to >= 0, label default ``Unknown``."""
    c = F.col
    out = sprints
    for name in ("bugs", "bugs_resolved", "bugs_pending", "test_cases", "velocity", "planned_velocity"):
        if name in sprints.columns:
            out = out.withColumn(name, F.greatest(F.coalesce(c(name), F.lit(0)), F.lit(0)))
    return out.withColumn("sprint", F.coalesce(F.nullif(c("sprint"), F.lit("")), F.lit("Unknown")))


def sanitize_summary(summary: DataFrame) -> DataFrame:
    """N7 for the summary: totals >= 0, total cases >= 1, automation 0-100."""
    c = F.col
    out = summary
    for name in summary.columns:
        if name in ("tc_total",):
            out = out.withColumn(name, F.greatest(F.coalesce(F.nullif(c(name), F.lit(0)), F.lit(1)), F.lit(1)))
        elif name == "test_automation":
            out = out.withColumn(name, F.least(F.greatest(F.coalesce(c(name), F.lit(0)), F.lit(0)), F.lit(100)))
        elif dict(summary.dtypes)[name] in ("bigint", "int", "double"):
            out = out.withColumn(name, F.greatest(F.coalesce(c(name), F.lit(0)), F.lit(0)))
    return out


def positive_times(times: Column) -> Column:
    """Keep only positive resolution times of an array column."""
    return F.filter(times, lambda x: x > 0)


def snapshot_diff(versions: DataFrame) -> DataFrame:
    """V7: each version's counts and their change vs the previous version
    (versions ordered by id; the first has null deltas)."""
    w = Window.orderBy("version")
    out = versions
    for cnt in ("bugs", "sprints", "developers"):
        out = out.withColumn(f"{cnt}_delta", F.col(cnt) - F.lag(cnt).over(w))
    return out
