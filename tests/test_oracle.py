"""Spark queries vs their DuckDB oracles on the smallest driver tables.

Every query of the library runs (the driver's own check uses sf0.01).
"""

import duckdb
import pytest

import __spark_entry__ as E
from defectlens.plans.catalog import load_all
from tests.conftest import SF_SMALL
from tools.compare import TABLES, digest

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _names():
    sqls = E.oracle_sql()
    return [n for n in load_all() if n in sqls]


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_oracle_or_is_documented():
    q, s = load_all(), E.oracle_sql()
    missing = [n for n in q if n not in s]
    assert missing == []


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "quality_index" in df.columns
