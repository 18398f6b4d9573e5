"""Named queries: (Spark plan over ``Tables``, DuckDB oracle SQL or None).

``__spark_entry__.queries()`` and ``oracle_sql()`` are views of ``REGISTRY``.
Every query reads the whole driver tables (through the adapter) and its work
grows with them; the oracle spells the same semantics over the same adapter.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from defectlens.sources.adapter import Tables


@dataclass
class QuerySpec:
    name: str
    fn: Callable[[Tables], DataFrame]
    sql: str | None
    operators: str


REGISTRY: dict[str, QuerySpec] = {}


def counted(sql: str) -> str:
    """``count_if(x)`` as ``count(CASE WHEN x THEN 1 END)``: DuckDB's own is NULL, not 0, where every x is NULL."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        end, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:i], "count(CASE WHEN ", counted(sql[i + len("count_if("):end - 1]), " THEN 1 END)"]
        at = end
    return "".join(out) + sql[at:]


def register(name: str, operators: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = QuerySpec(name, fn, counted(sql) if sql else None, operators)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    # Import for the side effect of registration (order = catalog order).
    from defectlens.plans import q_rollups, q_kpis, q_trends, q_rules, q_more, q_filters, q_io, q_tables  # noqa: F401
    return REGISTRY
