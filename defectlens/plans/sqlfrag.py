"""DuckDB SQL fragments mirroring ``defectlens.functions`` (oracle side).

Each helper spells the same IEEE operations in the same operand order as the
Spark Column builder, so results agree bit for bit.
"""

from __future__ import annotations


def jr(e: str) -> str:
    """js_round"""
    return f"CAST(floor(({e}) + 0.5) AS BIGINT)"


def f1(e: str) -> str:
    return f"(floor(({e}) * 10 + 0.5) / 10)"


def f6(e: str) -> str:
    return f"(floor(({e}) * 1000000 + 0.5) / 1000000)"


def f2(e: str) -> str:
    """toFixed(2) with the exact tie rule (see functions.jsnum.fixed2)."""
    v = f"CAST(({e}) AS DOUBLE)"
    a = f"abs({v})"
    p = f"({a} * 100.0)"
    c = f"({a} * 134217729.0)"
    hi = f"({c} - ({c} - {a}))"
    lo = f"({a} - {hi})"
    err = f"(({hi} * 100.0 - {p}) + {lo} * 100.0)"
    n = f"(CASE WHEN ({p} - floor({p}) = 0.5) AND {err} < 0 THEN floor({p} + 0.5) - 1 ELSE floor({p} + 0.5) END)"
    return f"(CASE WHEN {v} < 0 THEN -{n} / 100 ELSE {n} / 100 END)"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN {jr(f'({a}) / ({b}) * 100')} ELSE CAST(0 AS BIGINT) END)"


def truthy_or(x: str, d: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR ({x}) = 0 OR isnan(CAST(({x}) AS DOUBLE)) THEN ({d}) ELSE ({x}) END)"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def cnt(cond: str) -> str:
    return f"count_if({cond})"


def lst(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"


def strip_accents(e: str) -> str:
    return f"translate(lower({e}), '{ACCENTED}', '{PLAIN}')"


SPRINT_NUM = "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER)"

ISSUE_CTE = f"""issue AS (
  SELECT
    l_orderkey * 10 + l_linenumber AS issue_id,
    concat('Sprint ', CAST({SPRINT_NUM} AS VARCHAR)) AS sprint,
    {SPRINT_NUM} AS sprint_num,
    CASE WHEN (l_orderkey * 10 + l_linenumber) % 37 = 0 THEN NULL WHEN (l_orderkey * 10 + l_linenumber) % 37 = 1 THEN ''
         WHEN l_returnflag = 'R' THEN 'Bug' WHEN l_returnflag = 'A' THEN 'Sugerencia' ELSE 'Tarea' END AS issue_type,
    CASE (l_orderkey * 10 + l_linenumber) % 29 WHEN 0 THEN 'Reopened' WHEN 1 THEN 'Resolved' WHEN 2 THEN 'Tareas por hacer' WHEN 3 THEN NULL
    ELSE CASE WHEN l_linestatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN 'In Development'
         WHEN o_orderstatus = 'F' THEN 'Canceled' ELSE 'To Do' END END AS status,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Major' WHEN o_orderpriority = '1-URGENT' THEN 'Más alta' WHEN o_orderpriority = '2-HIGH' THEN 'Alta'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'Media' WHEN o_orderpriority = '5-LOW' THEN 'Baja' ELSE 'Más baja' END AS priority,
    CASE WHEN r_name NOT IN ('EUROPE', 'ASIA', 'MIDDLE EAST', 'AMERICA') AND p_partkey % 10 < 7 THEN 'CORE'
         WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 31 = 1 THEN '' ELSE p_type END AS module,
    p_brand AS category,
    CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN '' ELSE s_name END AS assignee,
    CASE r_name WHEN 'EUROPE' THEN 'PROD' WHEN 'ASIA' THEN 'UAT' WHEN 'MIDDLE EAST' THEN 'UAT'
         WHEN 'AMERICA' THEN 'SIT' ELSE 'DEV' END AS environment,
    c_mktsegment AS strategy,
    p_brand AS fix_version,
    list_filter(list_transform(regexp_split_to_array(replace(p_name, ' ', ';'), '[;,|]'),
                               lambda x: lower(trim(x))), lambda x: x <> '') AS tags,
    CASE WHEN p_partkey % 17 = 0 THEN p_name || ' test case' ELSE p_name END AS summary,
    o_orderdate AS created_at,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS resolved_at,
    CAST(l_quantity AS BIGINT) AS cases_planned,
    CASE WHEN ((year(o_orderdate) - 1995) * 12 + month(o_orderdate)) % 7 = 3 THEN CAST(l_quantity AS BIGINT) + 3
         WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS cases_executed
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""


def with_issue(body: str, *ctes: str) -> str:
    parts = [ISSUE_CTE] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body
