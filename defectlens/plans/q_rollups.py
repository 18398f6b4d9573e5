"""Roll-up, filter, distinct and top-k queries (A*, F*, O*, U*, J2, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectlens import config as C
from defectlens.operators import filters as FL
from defectlens.operators import rollups as R
from defectlens.operators import topk as TK
from defectlens.plans.catalog import register
from defectlens.plans.sqlfrag import jr, lst, pct, f1, with_issue, strip_accents

CRIT = lst(C.DEFAULT_PRIORITIES["critical"])
PEND2 = lst(C.PENDING_STATUS_PRIORITY_VIEW)
CLOSED = lst(C.CLOSED_STATUS_SQL)
BUG = "lower(issue_type) = 'bug'"


def flag(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


@register("issues_by_sprint", "A1", with_issue(f"""
SELECT sprint, count(*) AS total, count_if(priority IN ({lst(C.SPRINT_VIEW_CRITICAL)})) AS critical,
       count_if(status IN ({lst(C.PENDING_STATUS_SPRINT_VIEW)})) AS pending,
       count_if(status IN ({lst(C.CANCELED_STATUS)})) AS canceled
FROM issue GROUP BY sprint"""))
def q_issues_by_sprint(t):
    return R.issues_by_sprint(t.issues)


@register("issues_by_sprint_module", "A1 by module", with_issue(f"""
SELECT module, sprint, count(*) AS total, count_if(priority IN ({lst(C.SPRINT_VIEW_CRITICAL)})) AS critical,
       count_if(status IN ({lst(C.PENDING_STATUS_SPRINT_VIEW)})) AS pending,
       count_if(status IN ({lst(C.CANCELED_STATUS)})) AS canceled
FROM issue GROUP BY module, sprint"""))
def q_issues_by_sprint_module(t):
    return R.issues_by_sprint(t.issues, by=["module"])


@register("issues_by_priority", "A2", with_issue(f"""
SELECT priority, count(*) AS total, count_if(status IN ({PEND2})) AS pending
FROM issue GROUP BY priority"""))
def q_issues_by_priority(t):
    return R.issues_by_priority(t.issues)


_PB_LABELS = ", ".join(f"('{l}', {i})" for i, l in enumerate(C.PRIORITY_LABELS))


@register("priority_breakdown", "A12 J4 (by module)", with_issue(f"""
SELECT g.module, l.priority, CAST(l.label_order AS INTEGER) AS label_order,
       coalesce(a.c, 0) AS count, coalesce(a.p, 0) AS pending,
       coalesce(a.c, 0) - coalesce(a.p, 0) AS resolved
FROM (SELECT DISTINCT module FROM issue) g
CROSS JOIN (VALUES {_PB_LABELS}) AS l(priority, label_order)
LEFT JOIN agg a ON a.module IS NOT DISTINCT FROM g.module AND a.priority = l.priority""",
    f"agg AS (SELECT module, priority, count(*) AS c, count_if(status IN ({PEND2})) AS p "
    f"FROM issue GROUP BY module, priority)"))
def q_priority_breakdown(t):
    return R.priority_breakdown(t.issues, by=["module"])


@register("issues_by_assignee", "A3 F11", with_issue("""
SELECT assignee, count(*) AS total_bugs FROM issue
WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY assignee"""))
def q_issues_by_assignee(t):
    return R.issues_by_assignee(t.issues)


@register("assignee_summary", "A8 F9 F15", with_issue(f"""
SELECT assignee, count(*) AS total, {flag(f"status IN ({CLOSED})")} AS resolved,
       {flag(f"NOT (status IN ({CLOSED}))")} AS pending
FROM issue WHERE {BUG} GROUP BY assignee"""))
def q_assignee_summary(t):
    return R.assignee_summary(t.issues)


@register("assignee_rollup", "A15 N12 K29 K30 J8", with_issue(f"""
SELECT assignee, assigned, assigned - pending AS resolved, pending,
       CASE WHEN assigned > 20 THEN 'Alto' WHEN assigned > 10 THEN 'Medio' ELSE 'Bajo' END AS workload,
       {pct('assigned - pending', 'assigned')} AS efficiency,
       {pct('assigned', '(SELECT CAST(sum(assigned) AS BIGINT) FROM per)')} AS share
FROM per""", f"""per AS (SELECT assignee, count(*) AS assigned, count_if(status IN ({PEND2})) AS pending
FROM issue WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY assignee)"""))
def q_assignee_rollup(t):
    return R.assignee_rollup(t.issues)


@register("assignee_rollup_by_module", "A15 K30 J8 by module", with_issue(f"""
SELECT module, assignee, assigned, assigned - pending AS resolved, pending,
       CASE WHEN assigned > 20 THEN 'Alto' WHEN assigned > 10 THEN 'Medio' ELSE 'Bajo' END AS workload,
       {pct('assigned - pending', 'assigned')} AS efficiency,
       {pct('assigned', 'sum(assigned) OVER (PARTITION BY module)')} AS share
FROM per""", f"""per AS (SELECT module, assignee, count(*) AS assigned, count_if(status IN ({PEND2})) AS pending
FROM issue WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY module, assignee)"""))
def q_assignee_rollup_by_module(t):
    return R.assignee_rollup(t.issues, by=["module"])


@register("developers_from_issues", "A17 F14 N13 N15 K31", with_issue(f"""
SELECT assignee, total, resolved, total - resolved AS pending,
       CASE WHEN total - resolved > 15 THEN 'Alto' WHEN total - resolved > 8 THEN 'Medio' ELSE 'Bajo' END AS workload,
       {pct('resolved', 'total')} AS efficiency,
       least({jr('(total - resolved) / 15 * 100')}, 100) AS load_ratio
FROM (SELECT coalesce(nullif(trim(assignee), ''), 'Sin asignar') AS assignee, count(*) AS total,
             count_if(""" + " OR ".join(f"contains(lower(coalesce(status, '')), '{w}')" for w in C.CLOSED_STATUS_KEYWORDS) + f""") AS resolved
      FROM issue WHERE {BUG} GROUP BY 1)"""))
def q_developers_from_issues(t):
    return R.developers_from_issues(t.issues)


@register("issue_summary", "A5", with_issue(f"""
SELECT count(*) AS total, {flag(f"priority IN ({lst(C.SPRINT_VIEW_CRITICAL)})")} AS critical FROM issue"""))
def q_issue_summary(t):
    return R.issue_summary(t.issues)


@register("text_match_stats", "A4 F12", with_issue(f"""
SELECT count(*) AS total_records, {flag("lower(summary) LIKE '%test%'")} AS testcases_with_type FROM issue"""))
def q_text_match_stats(t):
    return R.text_match_stats(t.issues)


@register("resolution_stats", "A6 F15", with_issue(f"""
SELECT count_if(status IN ({CLOSED})) AS bugs_closed, count_if(environment = 'PROD') AS production_bugs FROM issue"""))
def q_resolution_stats(t):
    return R.resolution_stats(t.issues)


@register("team_summary", "A7 F9", with_issue(f"""
SELECT count(*) AS total_bugs, count(DISTINCT assignee) AS total_developers,
       {flag(f"status IN ({lst(C.PENDING_STATUS_TEAM)})")} AS total_pending,
       {flag(f"priority IN ({CRIT})")} AS total_critical
FROM issue WHERE {BUG}"""))
def q_team_summary(t):
    return R.team_summary(t.issues)


@register("team_summary_by_module", "A7 by module", with_issue(f"""
SELECT module, count(*) AS total_bugs, count(DISTINCT assignee) AS total_developers,
       {flag(f"status IN ({lst(C.PENDING_STATUS_TEAM)})")} AS total_pending,
       {flag(f"priority IN ({CRIT})")} AS total_critical
FROM issue WHERE {BUG} GROUP BY module"""))
def q_team_summary_by_module(t):
    return R.team_summary(t.issues, by=["module"])


@register("assignment_split", "A9 F11", with_issue(f"""
SELECT {flag("assignee IS NOT NULL AND assignee <> ''")} AS assigned_bugs,
       {flag("assignee IS NULL OR assignee = ''")} AS unassigned_bugs
FROM issue WHERE {BUG}"""))
def q_assignment_split(t):
    return R.assignment_split(t.issues)


@register("top_assignees", "O1", with_issue(f"""
SELECT assignee, count(*) AS total FROM issue WHERE {BUG}
GROUP BY assignee ORDER BY total DESC, assignee ASC NULLS FIRST LIMIT 5"""))
def q_top_assignees(t):
    return TK.top_assignees(t.issues, n=5)


@register("top_assignees_per_module", "O1 O2 per group", with_issue(f"""
SELECT module, assignee, total, rank FROM (
  SELECT module, assignee, total,
         CAST(row_number() OVER (PARTITION BY module ORDER BY total DESC, assignee ASC NULLS FIRST) AS INTEGER) AS rank
  FROM (SELECT module, assignee, count(*) AS total FROM issue WHERE {BUG} GROUP BY module, assignee))
WHERE rank <= 5"""))
def q_top_assignees_per_module(t):
    return TK.top_assignees(t.issues, n=5, by=["module"])


@register("developers_by_pending", "O4", with_issue(f"""
SELECT assignee, count_if(status IN ({PEND2})) AS pending FROM issue
WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY assignee"""))
def q_developers_by_pending(t):
    return TK.developers_by_pending(t.issues)


@register("max_pending_developer", "O12", with_issue(f"""
SELECT module, assignee, pending FROM (SELECT module, assignee, count_if(status IN ({PEND2})) AS pending FROM issue
  WHERE assignee IS NOT NULL AND assignee <> '' GROUP BY module, assignee)
QUALIFY row_number() OVER (PARTITION BY module ORDER BY pending DESC, assignee) = 1"""))
def q_max_pending_developer(t):
    return TK.max_pending_developer(TK.developers_by_pending(t.issues, ["module"]), ["module"])


@register("distinct_statuses", "U1", with_issue("SELECT DISTINCT status FROM issue"))
def q_distinct_statuses(t):
    return TK.distinct_values(t.issues, "status")


@register("distinct_issue_types", "U2", with_issue("SELECT DISTINCT issue_type FROM issue"))
def q_distinct_issue_types(t):
    return TK.distinct_values(t.issues, "issue_type")


_OPT = [("sprint", "sprint", "Other"), ("module", "module", "Other"), ("priority", "priority", "No priority"),
        ("status", "status", "Unknown"), ("developer", "assignee", "Unassigned"),
        ("category", "category", "Uncategorized"), ("fix_version", "fix_version", "Unknown"),
        ("strategy", "strategy", "Unknown"), ("environment", "environment", "Unknown")]


@register("filter_options", "U3 U5 N15", with_issue(
    "SELECT DISTINCT option, value FROM (" + " UNION ALL ".join(
        f"SELECT '{o}' AS option, coalesce(nullif(trim({c}), ''), '{d}') AS value FROM issue" for o, c, d in _OPT)
    + ")"))
def q_filter_options(t):
    return TK.filter_options(t.issues, _OPT)


@register("tag_counts", "N16 U4", with_issue("""
SELECT tag, count(*) AS total FROM (SELECT unnest(tags) AS tag FROM issue) GROUP BY tag"""))
def q_tag_counts(t):
    return TK.tag_counts(t.issues)


_TAGS = ["green", "red", "blue"]


@register("issues_with_tags", "F4 F1 per sprint", with_issue(f"""
SELECT sprint, count(*) AS total FROM issue
WHERE len(list_intersect(tags, [{lst(_TAGS)}])) > 0 GROUP BY sprint"""))
def q_issues_with_tags(t):
    iss = t.issues.filter(FL.tags_overlap(_TAGS))
    return iss.groupBy("sprint").agg(F.count(F.lit(1)).alias("total"))


@register("density_with_without_suggestions", "A10 F10 O5", with_issue(f"""
SELECT sprint, sprint_num, total_with_suggestions, total_without_suggestions,
       (SELECT {f1('avg(total_with_suggestions)')} FROM per) AS mean_with_suggestions,
       (SELECT {f1('sum(total_without_suggestions) / count_if(total_without_suggestions > 0)')} FROM per)
         AS mean_without_suggestions
FROM per""", """per AS (SELECT sprint, sprint_num, count(*) AS total_with_suggestions,
       count_if(issue_type <> 'Sugerencia') AS total_without_suggestions FROM issue GROUP BY sprint, sprint_num)"""))
def q_density(t):
    return R.density_with_without_suggestions(t.issues)


@register("issue_type_distribution", "A11", with_issue(
    "SELECT issue_type, count(*) AS total FROM issue GROUP BY issue_type"))
def q_issue_type_distribution(t):
    return R.issue_type_distribution(t.issues)


@register("module_breakdown", "A13 N15 J8", with_issue(f"""
SELECT key AS module, count, pending, {pct('count', '(SELECT sum(count) FROM per)')} AS percentage FROM per""",
    f"""per AS (SELECT coalesce(nullif(trim(module), ''), '{C.DEFAULT_MODULE_LABEL}') AS key, count(*) AS count,
       count_if(status IN ({PEND2})) AS pending FROM issue GROUP BY 1)"""))
def q_module_breakdown(t):
    return R.module_breakdown(t.issues)


@register("category_breakdown", "A14 N15 J8", with_issue(f"""
SELECT key AS category, count, {pct('count', '(SELECT sum(count) FROM per)')} AS percentage FROM per""",
    f"""per AS (SELECT coalesce(nullif(trim(category), ''), '{C.DEFAULT_CATEGORY_LABEL}') AS key, count(*) AS count
FROM issue GROUP BY 1)"""))
def q_category_breakdown(t):
    return R.category_breakdown(t.issues)


@register("top_modules", "A24 O3", with_issue("""
SELECT module, total FROM (SELECT coalesce(nullif(trim(module), ''), 'Other') AS module, count(*) AS total
FROM issue GROUP BY 1) ORDER BY total DESC, module ASC LIMIT 8"""))
def q_top_modules(t):
    return TK.top_modules(t.issues, n=8)


@register("sprint_status_pivot", "A25", with_issue("""
SELECT sprint, sprint_num, count_if(status = 'To Do') AS to_do, count_if(status = 'In Development') AS in_development,
       count_if(status = 'Done') AS done, count_if(status = 'Canceled') AS canceled
FROM issue GROUP BY sprint, sprint_num"""))
def q_sprint_status_pivot(t):
    return R.sprint_status_pivot(t.issues)


@register("assignee_module_summary", "A26", with_issue(f"""
SELECT assignee, module, count(*) AS total, count_if(status IN ({CLOSED})) AS resolved,
       count_if(NOT (status IN ({CLOSED}))) AS pending
FROM issue GROUP BY assignee, module"""))
def q_assignee_module_summary(t):
    return R.assignee_module_summary(t.issues)


@register("module_assignees", "A27", with_issue(
    "SELECT module, count(DISTINCT assignee) AS developers FROM issue GROUP BY module"))
def q_module_assignees(t):
    return R.module_assignees(t.issues)


@register("critical_state_series", "A29", with_issue(f"""
SELECT sprint, sprint_num, count_if(lower(status) = 'to do') AS to_do,
       count_if(lower(status) IN ('in development', 'in progress')) AS in_progress,
       count_if(lower(status) = 'reopened') AS reopened, count(*) AS total
FROM issue WHERE priority IN ({CRIT}) GROUP BY sprint, sprint_num"""))
def q_critical_state_series(t):
    return R.critical_state_series(t.issues)


@register("priority_canonical", "N10 X6 A30", with_issue(f"""
SELECT sprint, sprint_num, canonical, count(*) AS total FROM (
  SELECT sprint, sprint_num, CASE """ + " ".join(
    "WHEN " + " OR ".join(
        f"contains(regexp_replace({strip_accents('priority')}, '[^a-z0-9]', '', 'g'), '{w}')" for w in words)
    + f" THEN '{lab}'" for lab, words in __import__('defectlens.functions.text', fromlist=['x']).PRIORITY_KEYWORDS)
    + """ ELSE 'Other' END AS canonical FROM issue) GROUP BY sprint, sprint_num, canonical"""))
def q_priority_canonical(t):
    return TK.canonical_priority_counts(t.issues)


@register("severity_shares", "A28 K30", with_issue(f"""
SELECT module, priority, count, {pct('count', 'sum(count) OVER (PARTITION BY module)')} AS share
FROM (SELECT module, priority, count(*) AS count FROM issue GROUP BY module, priority)"""))
def q_severity_shares(t):
    return R.severity_share(t.issues, by=["module"])
