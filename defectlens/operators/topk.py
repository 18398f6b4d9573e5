"""Sorts, limits, top-k (O1-O13) and distinct / option lists.

Global top-k is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject (per-partition top-k, then a k-row merge), never a full
sort on one task.  Per-group top-k is ``row_number() <= k`` over a window
partitioned by the group keys on the aggregated rows.  Every order has a
deterministic tiebreak on the key (SQL NULLs first, as SQLite sorts them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.functions.text import canonical_priority, label_or
from defectlens.operators.filters import is_assigned
from defectlens.operators.rollups import bug_rows, keys


def top_k(df: DataFrame, order, n: int, by=None, rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows by ``order`` overall, or per group of ``by``."""
    by = keys(by)
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def top_assignees(issues: DataFrame, n: int = 5, by=None) -> DataFrame:
    """O1/O2: top developers by bug count (NULL assignee kept as a group)."""
    by = keys(by)
    agg = bug_rows(issues).groupBy(*by, "assignee").agg(F.count(F.lit(1)).alias("total"))
    return top_k(agg, [F.desc("total"), F.asc_nulls_first("assignee")], n, by)


def developers_by_pending(issues: DataFrame, by=None) -> DataFrame:
    """Every developer with the pending issues, ordered by pending desc.

    One aggregate and one range-partitioned sort; nothing is numbered, since a
    rank over all developers would need them in one task (O12 is its own
    aggregate, ``max_pending_developer``).
    """
    by = keys(by)
    agg = issues.filter(is_assigned()).groupBy(*by, "assignee").agg(
        F.count_if(F.col("status").isin(C.PENDING_STATUS_PRIORITY_VIEW)).alias("pending"))
    return agg.orderBy(*by, F.desc("pending"), F.asc_nulls_first("assignee"))


def max_pending_developer(devs: DataFrame, by=None) -> DataFrame:
    """The developer with the most pending issues per group (ties: the
    first name in order) -- ``min_by`` over (-pending, name), one aggregate."""
    return devs.groupBy(*keys(by)).agg(
        F.min_by("assignee", F.struct(-F.col("pending"), F.col("assignee"))).alias("assignee"),
        F.max("pending").alias("pending"))


def top_modules(issues: DataFrame, n: int = 8, by=None) -> DataFrame:
    """O3 + A24."""
    by = keys(by)
    agg = issues.groupBy(*by, label_or("module", "Other").alias("module")).agg(F.count(F.lit(1)).alias("total"))
    return top_k(agg, [F.desc("total"), F.asc("module")], n, by)


def distinct_values(issues: DataFrame, col: str) -> DataFrame:
    """Distinct values (partial distinct before the shuffle)."""
    return issues.select(col).distinct()


def filter_options(issues: DataFrame, options) -> DataFrame:
    """Every filter list at once: one ``stack`` (unpivot) of the
    trimmed, defaulted columns, then one distinct over (option, value).
    ``options`` = [(option name, column, default label)].  Sort for display
    with ``orderBy('option', collate('value', 'UNICODE'))``.
    """
    arr = F.array(*[F.struct(F.lit(o).alias("option"), label_or(c, d).alias("value"))
                    for o, c, d in options])
    return issues.select(F.inline(arr)).distinct()


def tag_counts(issues: DataFrame, by=None) -> DataFrame:
    """U4 + N16: explode the tag arrays, count per tag."""
    return (issues.select(*keys(by), F.explode("tags").alias("tag"))
            .groupBy(*keys(by), "tag").agg(F.count(F.lit(1)).alias("total")))


def canonical_priority_counts(issues: DataFrame, by=None) -> DataFrame:
    """N10 + A30: issues per sprint and canonical priority."""
    return (issues.groupBy(*keys(by), "sprint", "sprint_num",
                           canonical_priority("priority").alias("canonical"))
            .agg(F.count(F.lit(1)).alias("total")))


def first_n_sprints(sprints: DataFrame, n: int) -> DataFrame:
    """First ``n`` sprints by number (a sample feature)."""
    return sprints.orderBy("sprint_num", "sprint").limit(n)


def sprints_by_suffix(df: DataFrame, col: str = "sprint") -> DataFrame:
    """Order by the numeric suffix of the label (last two characters)."""
    return df.orderBy(F.trim(F.substring(F.col(col), -2, 2)).try_cast("int"), F.col(col))


def sorted_options(options: DataFrame) -> DataFrame:
    """U3 display order: per option, values in locale order (``localeCompare``
    -> ``UNICODE`` collation), with the position as a column."""
    w = Window.partitionBy("option").orderBy(F.collate(F.col("value"), "UNICODE"))
    return options.withColumn("position", F.row_number().over(w))
