"""Plan guards over every registered query: no cartesian products or
nested-loop joins, no Python UDF evaluation, partial aggregation present."""

import pytest

from defectlens.plans.catalog import load_all
from defectlens.sources.adapter import loaded_tables
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.fixture(scope="module")
def tables(spark):
    return loaded_tables(spark, SF_SMALL)


@pytest.mark.parametrize("name", list(load_all()))
def test_plan_guard(spark, tables, name):
    df = load_all()[name].fn(tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    n_agg = plan.count("HashAggregate(") + plan.count("SortAggregate(")
    if n_agg:
        # every aggregate runs a map-side phase: partial functions, or (for a
        # distinct) a key-only HashAggregate below the final one
        assert "partial_" in plan or n_agg >= 2, f"{name}: aggregate without a map-side phase"
