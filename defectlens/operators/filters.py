"""Filters F1-F17 as Column builders (composable, pushed down by Catalyst).

Case-insensitive tests compare ``lower(col)`` with lower-cased literals.  On a
materialized issue table, the equality-style predicates on raw columns (e.g.
``status IN (...)`` from F15) reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.functions.text import split_tags


def parse_list(value) -> list[str] | None:
    """comma split, trim, drop blanks, lowercase; empty -> None (no filter)."""
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        value = ",".join(str(v) for v in value)
    items = [s.strip().lower() for s in str(value).split(",")]
    items = [s for s in items if s]
    return items or None


def _any(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def _all(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def _str(col: str) -> Column:
    return F.lower(F.coalesce(F.col(col).cast("string"), F.lit("")))


def sprint_contains_any(sprints: list[str], col: str = "sprint") -> Column:
    """case-insensitive substring, any of the list."""
    return _any(_str(col).contains(s.lower()) for s in sprints)


def ci_in(col: str, values: list[str], columns=None) -> Column:
    """``lower(col) IN values`` (missing -> '').  When the table stores
    the lower-cased key ``<col>_lc`` (bulk load), the test is on that column
    so it is pushed down to the Parquet scan."""
    vals = [v.lower() for v in values]
    if columns is not None and f"{col}_lc" in columns:
        return F.col(f"{col}_lc").isin(vals)
    return _str(col).isin(vals)


def tags_overlap(tags: list[str], col: str = "tags") -> Column:
    """any requested tag among the row tags (array column)."""
    return F.arrays_overlap(F.col(col), F.array(*[F.lit(t.lower()) for t in tags]))


def tags_overlap_text(tags: list[str], col: str) -> Column:
    """F4 on a raw text tag field (split on ``[;,|]``)."""
    return F.arrays_overlap(split_tags(col), F.array(*[F.lit(t.lower()) for t in tags]))


def issue_filter(sprints=None, status=None, priority=None, tags=None, environment=None,
                 strategy=None, fix_version=None, columns=None) -> Column:
    """AND of the list parameters given; each list is parsed by F1.
    Pass ``columns=df.columns`` to use stored lower-cased keys (pushdown)."""
    conds = []
    sprints, status, priority = parse_list(sprints), parse_list(status), parse_list(priority)
    tags, environment = parse_list(tags), parse_list(environment)
    strategy, fix_version = parse_list(strategy), parse_list(fix_version)
    if sprints:
        conds.append(sprint_contains_any(sprints))
    if status:
        conds.append(ci_in("status", status, columns))
    if priority:
        conds.append(ci_in("priority", priority, columns))
    if tags:
        conds.append(tags_overlap(tags))
    if environment:
        conds.append(ci_in("environment", environment, columns))
    if strategy:
        conds.append(ci_in("strategy", strategy, columns))
    if fix_version:
        conds.append(ci_in("fix_version", fix_version, columns))
    return _all(conds)


def _sel(values) -> list[str] | None:
    """'All' (or nothing) disables a selector; values are trimmed + lowered."""
    if not values:
        return None
    vals = [str(v).strip().lower() for v in values]
    return None if "all" in vals else vals


def global_filter(status=None, priority=None, developer=None, category=None, fix_version=None,
                  strategy=None, environment=None) -> Column:
    """F5 + F6: AND of multi-select filters; ``All`` disables each one."""
    conds = []
    for col, vals in (("status", status), ("priority", priority), ("assignee", developer),
                      ("category", category), ("fix_version", fix_version),
                      ("strategy", strategy), ("environment", environment)):
        v = _sel(vals)
        if v:
            conds.append(F.lower(F.trim(F.coalesce(F.col(col), F.lit("")))).isin(v))
    return _all(conds)


def test_type(environment: str = "environment", tags: str | None = None,
              explicit: str | None = None) -> Column:
    """Explicit test type, else environment UAT / tag containing uat or
    equipo -> 'uat', else 'system'."""
    env_uat = F.upper(F.coalesce(F.col(environment), F.lit(""))) == "UAT"
    tag_uat = F.lit(False)
    if tags:
        tl = F.lower(F.coalesce(F.col(tags).cast("string"), F.lit("")))
        tag_uat = tl.contains("uat") | tl.contains("equipo")
    derived = F.when(env_uat | tag_uat, "uat").otherwise("system")
    if explicit:
        return F.coalesce(F.nullif(F.lower(F.col(explicit)), F.lit("")), derived)
    return derived


def sprint_filter(sprints=None, version=None, test_type_value: str | None = None,
                  test_type_col: str | None = None) -> Column:
    """Exact sprint set, version and test type on sprint rows."""
    conds = []
    s = _sel(sprints)
    if s:
        conds.append(F.lower(F.trim(F.col("sprint"))).isin(s))
    v = _sel(version)
    if v:
        conds.append(F.lower(F.trim(F.coalesce(F.col("version"), F.lit("")))).isin(v))
    if test_type_value and test_type_value.lower() != "all" and test_type_col:
        conds.append(F.col(test_type_col) == test_type_value.lower())
    return _all(conds)


def sprint_row_filter(tags=None, strategy=None, environment=None, tags_col: str = "tags") -> Column:
    """F8 (older copy): sprint rows by tag overlap and by strategy /
    environment (case-insensitive, ``All`` disables)."""
    conds = []
    t = _sel(tags)
    if t:
        conds.append(F.arrays_overlap(F.transform(F.coalesce(F.col(tags_col), F.array().cast("array<string>")),
                                                  lambda x: F.lower(F.trim(x))), F.array(*[F.lit(x) for x in t])))
    for col, vals in (("strategy", strategy), ("environment", environment)):
        v = _sel(vals)
        if v:
            conds.append(F.lower(F.trim(F.coalesce(F.col(col), F.lit("")))).isin(v))
    return _all(conds)


def is_bug(col: str = "issue_type") -> Column:
    """F9."""
    return F.lower(F.col(col)) == "bug"


def not_suggestion(col: str = "issue_type", value: str = "Sugerencia") -> Column:
    """``col != value`` (NULL dropped, as in SQL)."""
    return F.col(col) != value


def is_assigned(col: str = "assignee") -> Column:
    """F11."""
    return F.col(col).isNotNull() & (F.col(col) != "")


def summary_like(pattern: str = "%test%", col: str = "summary") -> Column:
    """F12."""
    return F.lower(F.col(col)).like(pattern)


def closed_exact(col: str = "status") -> Column:
    """lower(status) in the exact closed set."""
    return F.lower(F.col(col)).isin(C.CLOSED_STATUS_EXACT)


def closed_keyword(col: str = "status") -> Column:
    """status contains a closed keyword."""
    s = F.lower(F.coalesce(F.col(col), F.lit("")))
    return _any(s.contains(w) for w in C.CLOSED_STATUS_KEYWORDS)


def closed_sql(col: str = "status") -> Column:
    """case-sensitive ``IN ('Done','Resolved','Closed')``."""
    return F.col(col).isin(C.CLOSED_STATUS_SQL)


def visible_metrics(df: DataFrame, metrics: list[str] | None, col: str = "metric") -> DataFrame:
    """F16: keep listed metrics; no list keeps all."""
    return df if not metrics else df.filter(F.col(col).isin(list(metrics)))


def having(df: DataFrame, col: str, threshold, op: str = ">") -> DataFrame:
    """threshold predicate on an aggregate column."""
    c = F.col(col)
    cond = {">": c > threshold, ">=": c >= threshold, "<": c < threshold, "<=": c <= threshold}[op]
    return df.filter(cond)
