"""Aggregations A1-A35 over the issue fact frame and the sprint roll-up.

Each aggregate is a ``groupBy(by + keys).agg(...)``: Spark runs a map-side
partial aggregate before the shuffle, so a hot key (one assignee or module
holding a third of all issues) costs one partial row per task, never a giant
task.  Conditional counts use ``count_if`` inside the same pass, so a view
with five measures still reads the issue table once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlens import config as C
from defectlens.functions import fixed1, js_round, label_or, pct, first_truthy


def keys(by) -> list[str]:
    return list(by or [])


def _isin(col: str, values) -> Column:
    return F.col(col).isin(list(values))


def bug_rows(df: DataFrame) -> DataFrame:
    """F9 as a row filter: on a loaded table by the stored lower-cased label, which the reader can skip by."""
    if "issue_type_lc" in df.columns:
        return df.filter(F.col("issue_type_lc") == "bug")
    return df.filter(F.lower(F.col("issue_type")) == "bug")


def is_assigned(col: str = "assignee") -> Column:
    """not null and not ''."""
    return F.col(col).isNotNull() & (F.col(col) != "")


def sum_long(c) -> Column:
    return F.sum(c).cast("long")


def sum_flag(cond: Column) -> Column:
    """SQL ``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: NULL over zero rows."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def join_null_safe(left: DataFrame, right: DataFrame, by, how: str = "left") -> DataFrame:
    """Equi-join on the keys where a NULL key meets the NULL key; keys once."""
    names = {k: f"{k}__right" for k in by}
    r = right.withColumnsRenamed(names)
    cond = [left[k].eqNullSafe(r[names[k]]) for k in by]
    return left.join(r, reduce(lambda a, b: a & b, cond), how).drop(*names.values())


def with_group_total(df: DataFrame, value: str, by, alias: str) -> DataFrame:
    """Attach the per-group (or global) total of ``value`` to every row.

    With grouping keys the totals (one row per group) are joined back on the
    keys; without keys the global total is a scalar subquery, evaluated once
    as its own small aggregate job.  Neither moves the rows into one task.
    """
    by = keys(by)
    if by:
        tot = df.groupBy(*by).agg(F.sum(value).cast("long").alias(alias))
        return join_null_safe(df, tot, by)
    return df.withColumn(alias, df.select(F.sum(value).cast("long")).scalar())


# ---------------------------------------------------------------- sprint view

def issues_by_sprint(issues: DataFrame, by=None,
                     critical_labels=C.SPRINT_VIEW_CRITICAL,
                     pending_status=C.PENDING_STATUS_SPRINT_VIEW,
                     canceled_status=C.CANCELED_STATUS) -> DataFrame:
    """A1: total, critical, pending and canceled issues per sprint."""
    return issues.groupBy(*keys(by), "sprint").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_isin("priority", critical_labels)).alias("critical"),
        F.count_if(_isin("status", pending_status)).alias("pending"),
        F.count_if(_isin("status", canceled_status)).alias("canceled"),
    )


def issues_by_priority(issues: DataFrame, by=None,
                       pending_status=C.PENDING_STATUS_PRIORITY_VIEW) -> DataFrame:
    """A2: issues and pending issues per priority label."""
    return issues.groupBy(*keys(by), "priority").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_isin("status", pending_status)).alias("pending"),
    )


def issues_by_assignee(issues: DataFrame, by=None) -> DataFrame:
    """A3: issues per non-blank assignee."""
    return (issues.filter(is_assigned())
            .groupBy(*keys(by), "assignee").agg(F.count(F.lit(1)).alias("total_bugs")))


def text_match_stats(issues: DataFrame, by=None, pattern: str = "%test%") -> DataFrame:
    """A4: records and records whose summary matches a LIKE pattern."""
    return issues.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("total_records"),
        sum_flag(F.lower(F.col("summary")).like(pattern)).alias("testcases_with_type"),
    )


def issue_summary(issues: DataFrame, by=None, critical_labels=C.SPRINT_VIEW_CRITICAL) -> DataFrame:
    """A5: total and critical issues."""
    return issues.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("total"),
        sum_flag(_isin("priority", critical_labels)).alias("critical"),
    )


def resolution_stats(issues: DataFrame, by=None, closed_status=C.CLOSED_STATUS_SQL,
                     production_env: str = "PROD") -> DataFrame:
    """Closed issues and production issues (the real measure)."""
    return issues.groupBy(*keys(by)).agg(
        F.count_if(_isin("status", closed_status)).alias("bugs_closed"),
        F.count_if(F.col("environment") == production_env).alias("production_bugs"),
    )


def team_summary(issues: DataFrame, by=None, pending_status=C.PENDING_STATUS_TEAM,
                 critical_labels=C.DEFAULT_PRIORITIES["critical"]) -> DataFrame:
    """Bugs, distinct developers, pending and critical (bugs only)."""
    return bug_rows(issues).groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("total_bugs"),
        F.count_distinct("assignee").alias("total_developers"),
        sum_flag(_isin("status", pending_status)).alias("total_pending"),
        sum_flag(_isin("priority", critical_labels)).alias("total_critical"),
    )


def assignee_summary(issues: DataFrame, by=None, closed_status=C.CLOSED_STATUS_SQL) -> DataFrame:
    """Per assignee (NULL group kept) total, resolved, pending; bugs only.

    ``NOT IN`` keeps SQL three-valued logic: a NULL status is neither.
    """
    closed = _isin("status", closed_status)
    return bug_rows(issues).groupBy(*keys(by), "assignee").agg(
        F.count(F.lit(1)).alias("total"),
        sum_flag(closed).alias("resolved"),
        sum_flag(~closed).alias("pending"),
    )


def assignment_split(issues: DataFrame, by=None) -> DataFrame:
    """Assigned vs unassigned bugs."""
    a = is_assigned()
    return bug_rows(issues).groupBy(*keys(by)).agg(
        sum_flag(a).alias("assigned_bugs"),
        sum_flag(F.col("assignee").isNull() | (F.col("assignee") == "")).alias("unassigned_bugs"),
    )


def density_with_without_suggestions(issues: DataFrame, by=None,
                                     suggestion_type: str = "Sugerencia") -> DataFrame:
    """A10 + F10: per sprint, issues with and without suggestions, and the
    mean over sprints of each (1 decimal).  ``issue_type != x`` drops NULL
    types, as SQL does; a sprint with no non-suggestion issue is absent from
    the second series, so its mean divides by the sprints that have one.
    """
    by = keys(by)
    per = issues.groupBy(*by, "sprint", "sprint_num").agg(
        F.count(F.lit(1)).alias("total_with_suggestions"),
        F.count_if(F.col("issue_type") != suggestion_type).alias("total_without_suggestions"),
    )
    stats = per.groupBy(*by).agg(
        fixed1(F.avg("total_with_suggestions")).alias("mean_with_suggestions"),
        fixed1(F.sum("total_without_suggestions")
               / F.count_if(F.col("total_without_suggestions") > 0)).alias("mean_without_suggestions"),
    )
    if by:
        return join_null_safe(per, stats, by)
    one = stats.select(F.struct(*stats.columns).alias("_s")).scalar()
    return per.withColumns({c: one[c] for c in stats.columns})


def issue_type_distribution(issues: DataFrame, by=None) -> DataFrame:
    """Issues per type, NULL type included."""
    return issues.groupBy(*keys(by), "issue_type").agg(F.count(F.lit(1)).alias("total"))


def priority_breakdown(issues: DataFrame, by=None, labels=C.PRIORITY_LABELS,
                       pending_status=C.PENDING_STATUS_PRIORITY_VIEW) -> DataFrame:
    """A12 + J4: fixed priority labels, count / pending / resolved, 0 if absent.

    The label lookup with a 0 default is one conditional count per label in a
    single aggregate, then one ``explode`` of a fixed-size array turns the
    columns into one row per label: no join, no second pass.
    """
    by = keys(by)
    pend = _isin("status", pending_status)
    aggs = []
    for i, lab in enumerate(labels):
        aggs.append(F.count_if(F.col("priority") == lab).alias(f"c{i}"))
        aggs.append(F.count_if((F.col("priority") == lab) & pend).alias(f"p{i}"))
    wide = issues.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(lab).alias("priority"), F.lit(i).alias("label_order"),
                              F.col(f"c{i}").alias("count"), F.col(f"p{i}").alias("pending"))
                     for i, lab in enumerate(labels)])
    out = wide.select(*by, F.inline(rows))
    return out.withColumn("resolved", F.col("count") - F.col("pending"))


def share_breakdown(issues: DataFrame, dim_col: str, default_label: str, by=None,
                    pending_status=C.PENDING_STATUS_PRIORITY_VIEW,
                    with_pending: bool = True) -> DataFrame:
    """Count per label, ``Math.round(count / total * 100)``, pending."""
    by = keys(by)
    lab = label_or(dim_col, default_label).alias("key")
    aggs = [F.count(F.lit(1)).alias("count")]
    if with_pending:
        aggs.append(F.count_if(_isin("status", pending_status)).alias("pending"))
    per = issues.groupBy(*by, lab).agg(*aggs)
    per = with_group_total(per, "count", by, "_total")
    return per.withColumn("percentage", pct(F.col("count"), F.col("_total"))).drop("_total")


def module_breakdown(issues: DataFrame, by=None) -> DataFrame:
    """A13."""
    return share_breakdown(issues, "module", C.DEFAULT_MODULE_LABEL, by).withColumnRenamed("key", "module")


def category_breakdown(issues: DataFrame, by=None) -> DataFrame:
    """A14."""
    return (share_breakdown(issues, "category", C.DEFAULT_CATEGORY_LABEL, by, with_pending=False)
            .withColumnRenamed("key", "category"))


def workload_by_total(total: Column) -> Column:
    """>20 Alto, >10 Medio, else Bajo."""
    return F.when(total > 20, "Alto").when(total > 10, "Medio").otherwise("Bajo")


def workload_by_pending(pending: Column, threshold: int = 15) -> Column:
    """>T Alto, >round(T/2) Medio, else Bajo."""
    half = int((threshold / 2) + 0.5)
    return F.when(pending > threshold, "Alto").when(pending > half, "Medio").otherwise("Bajo")


def assignee_rollup(issues: DataFrame, by=None, pending_status=C.PENDING_STATUS_PRIORITY_VIEW) -> DataFrame:
    """A15 + N12 + K29 + K30: developer record from issues (non-blank names).

    resolved = assigned - pending; efficiency = pct(resolved, assigned);
    share = pct(assigned, all assigned in the group).
    """
    by = keys(by)
    per = issues.filter(is_assigned()).groupBy(*by, "assignee").agg(
        F.count(F.lit(1)).alias("assigned"),
        F.count_if(_isin("status", pending_status)).alias("pending"),
    )
    per = per.withColumn("resolved", F.col("assigned") - F.col("pending"))
    per = with_group_total(per, "assigned", by, "_all")
    return per.select(
        *by, "assignee", "assigned", "resolved", "pending",
        workload_by_total(F.col("assigned")).alias("workload"),
        pct(F.col("resolved"), F.col("assigned")).alias("efficiency"),
        pct(F.col("assigned"), F.col("_all")).alias("share"),
    )


def developers_from_issues(issues: DataFrame, by=None, threshold: int = 15,
                           closed_keywords=C.CLOSED_STATUS_KEYWORDS) -> DataFrame:
    """A17 + F14 + N13 + K31: developer table derived from issues (bugs only).

    Closed = status contains any closed keyword (case-insensitive); missing
    names become ``Sin asignar``.
    """
    by = keys(by)
    st = F.lower(F.coalesce(F.col("status"), F.lit("")))
    closed = None
    for w in closed_keywords:
        closed = st.contains(w) if closed is None else (closed | st.contains(w))
    per = (bug_rows(issues)
           .groupBy(*by, label_or("assignee", C.DEFAULT_ASSIGNEE_LABEL).alias("assignee"))
           .agg(F.count(F.lit(1)).alias("total"), F.count_if(closed).alias("resolved")))
    pending = F.col("total") - F.col("resolved")
    return per.select(
        *by, "assignee", "total", "resolved", pending.alias("pending"),
        workload_by_pending(pending, threshold).alias("workload"),
        pct(F.col("resolved"), F.col("total")).alias("efficiency"),
        F.least(js_round(pending / F.lit(threshold) * 100), F.lit(100)).alias("load_ratio"),
    )


def issues_by_module(issues: DataFrame, by=None, default_label: str = "Other") -> DataFrame:
    """Issues per module from the issue rows, default ``Other``."""
    return (issues.groupBy(*keys(by), label_or("module", default_label).alias("module"))
            .agg(F.count(F.lit(1)).alias("total")))


def sprint_status_pivot(issues: DataFrame, by=None,
                        statuses=("To Do", "In Development", "Done", "Canceled")) -> DataFrame:
    """Issues per sprint and status, one column per status (explicit
    value list, so the pivot needs no extra distinct job)."""
    names = {s: s.lower().replace(" ", "_") for s in statuses}
    p = (issues.groupBy(*keys(by), "sprint", "sprint_num").pivot("status", list(statuses))
         .agg(F.count(F.lit(1))))
    return p.select(*keys(by), "sprint", "sprint_num",
                    *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias(n) for s, n in names.items()])


def sprint_status_long(issues: DataFrame, by=None) -> DataFrame:
    """A25, long form: (sprint, status, total)."""
    return issues.groupBy(*keys(by), "sprint", "status").agg(F.count(F.lit(1)).alias("total"))


def assignee_module_summary(issues: DataFrame, by=None, closed_status=C.CLOSED_STATUS_SQL) -> DataFrame:
    """Per (assignee, module) total, resolved, pending."""
    closed = _isin("status", closed_status)
    return issues.groupBy(*keys(by), "assignee", "module").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(closed).alias("resolved"),
        F.count_if(~closed).alias("pending"),
    )


def module_assignees(issues: DataFrame, by=None) -> DataFrame:
    """Distinct developers per module (count only: the name list of a
    module is bounded by the number of assignees, not rows, but can still be
    large, so the long form ``assignee_module_summary`` carries names)."""
    return issues.groupBy(*keys(by), "module").agg(F.count_distinct("assignee").alias("developers"))


def critical_state_series(issues: DataFrame, by=None, critical_labels=C.DEFAULT_PRIORITIES["critical"]) -> DataFrame:
    """Critical issues per sprint by state (to do, in progress, reopened, sum)."""
    crit = _isin("priority", critical_labels)
    st = F.lower(F.col("status"))
    return issues.filter(crit).groupBy(*keys(by), "sprint", "sprint_num").agg(
        F.count_if(st == "to do").alias("to_do"),
        F.count_if(st.isin("in development", "in progress")).alias("in_progress"),
        F.count_if(st == "reopened").alias("reopened"),
        F.count(F.lit(1)).alias("total"),
    )


def selected_sprint_totals(sprints: DataFrame, by=None) -> DataFrame:
    """Totals over the (already filtered) sprint rows.

    bugs, resolved, executed and planned cases, findings per sprint stats
    (mean with one decimal, max, min, count).
    """
    return sprints.groupBy(*keys(by)).agg(
        sum_long("bugs").alias("total_bugs"),
        sum_long("bugs_resolved").alias("total_resolved"),
        sum_long("test_cases").alias("total_executed"),
        sum_long(first_truthy("test_planned", "test_cases")).alias("total_planned"),
        sum_long("critical_total").alias("critical_total"),
        sum_long("critical_pending").alias("critical_pending"),
        fixed1(F.avg("bugs")).alias("avg_bugs_per_sprint"),
        F.max("bugs").alias("max_bugs"),
        F.min("bugs").alias("min_bugs"),
        F.count(F.lit(1)).alias("n_sprints"),
        pct(F.sum("test_cases"), F.sum(first_truthy("test_planned", "test_cases"))).alias("execution_rate"),
    )


def team_totals(devs: DataFrame, total_issues: DataFrame | None = None, by=None) -> DataFrame:
    """A22 + A23: developers, pending, overall efficiency from a developer table."""
    return devs.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("developers"),
        sum_long("pending").alias("pending"),
        sum_long("assigned").alias("assigned"),
        pct(F.sum("resolved"), F.sum("assigned")).alias("efficiency"),
    )


def severity_share(issues: DataFrame, by=None, dim: str = "priority") -> DataFrame:
    """Count per severity label and its share of the group total."""
    by = keys(by)
    per = issues.groupBy(*by, dim).agg(F.count(F.lit(1)).alias("count"))
    per = with_group_total(per, "count", by, "_total")
    return per.withColumn("share", pct(F.col("count"), F.col("_total"))).drop("_total")


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def team_overview(issues: DataFrame, by=None, pending_status=C.PENDING_STATUS_PRIORITY_VIEW) -> DataFrame:
    """A22 + A23: developers, pending, assigned, overall efficiency and the
    unassigned remainder ``max(0, total - assigned)`` per group, in one pass."""
    assigned = is_assigned()
    g = issues.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(assigned, F.col("assignee"))).alias("developers"),
        F.count_if(assigned).alias("assigned"),
        F.count_if(assigned & F.col("status").isin(list(pending_status))).alias("pending"),
    )
    return g.select(*keys(by), "total", "developers", "assigned", "pending",
                    pct(F.col("assigned") - F.col("pending"), F.col("assigned")).alias("efficiency"),
                    F.greatest(F.lit(0), F.col("total") - F.col("assigned")).cast("long").alias("unassigned"))


def source_statistics(sprints: DataFrame, by=None) -> DataFrame:
    """Totals, sprints, critical and pending from sprint rows whose
    column names vary (first present alias wins)."""
    cols = set(sprints.columns)

    def pick(*names):
        got = [F.col(n) for n in names if n in cols]
        return F.coalesce(*got, F.lit(0)) if got else F.lit(0)
    return sprints.groupBy(*keys(by)).agg(
        F.sum(pick("bugs", "total", "total_bugs")).cast("long").alias("total_bugs"),
        F.count(F.lit(1)).alias("total_sprints"),
        F.sum(pick("critical_total", "critical", "critical_bugs")).cast("long").alias("critical_bugs"),
        F.sum(pick("bugs_pending", "pending", "pending_bugs")).cast("long").alias("pending_bugs"),
    )


def top2_priority_sum(priority_map) -> Column:
    """Sum of the two largest counts of a priority -> count map."""
    top = F.slice(F.sort_array(F.map_values(priority_map), asc=False), 1, 2)
    return F.aggregate(top, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


def assignee_pending(issues: DataFrame, by=None, pending_status=C.PENDING_STATUS_PRIORITY_VIEW) -> DataFrame:
    """Pending issues per non-blank assignee (the input of R2 / R8 / R19)."""
    return issues.filter(is_assigned()).groupBy(*keys(by), "assignee").agg(
        F.count_if(_isin("status", pending_status)).alias("pending"))


def card_totals(selected: DataFrame, summary: DataFrame, by=None) -> DataFrame:
    """Bugs / executed / planned for the metric cards: sums over the
    selected sprint rows (each with its alias chain), or the summary totals
    when no sprint is selected.  ``summary``: one row per group with
    total_bugs, tc_executed, tc_total.  One union + conditional aggregate."""
    by = keys(by)
    cols = set(selected.columns)

    def chain(*names):
        got = [F.col(n) for n in names if n in cols]
        return first_truthy(*got) if got else F.lit(0)
    s = selected.select(*by, F.lit(1).alias("_sel"), chain("bugs", "bugs_found").alias("b"),
                        chain("test_cases", "test_cases_executed").alias("e"),
                        chain("test_planned", "test_cases_planned", "test_cases").alias("p"))
    m = summary.select(*by, F.lit(0).alias("_sel"), F.col("total_bugs").alias("b"),
                       F.col("tc_executed").alias("e"), F.col("tc_total").alias("p"))
    g = s.unionByName(m).groupBy(*by).agg(
        F.count_if(F.col("_sel") == 1).alias("selected_sprints"),
        *[F.sum(F.when(F.col("_sel") == 1, F.col(x))).cast("long").alias(f"s_{x}") for x in "bep"],
        *[F.max(F.when(F.col("_sel") == 0, F.col(x))).cast("long").alias(f"m_{x}") for x in "bep"])
    use = F.col("selected_sprints") > 0
    return g.select(*by, "selected_sprints",
                    *[F.when(use, F.col(f"s_{x}")).otherwise(F.coalesce(F.col(f"m_{x}"), F.lit(0))).alias(n)
                      for x, n in (("b", "bugs"), ("e", "executed"), ("p", "planned"))])
