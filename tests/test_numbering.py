"""Two-pass positions equal a window's row numbers, whatever the groups and ties."""

import random

import pytest
from pyspark.sql import functions as F

from defectlens.operators.numbering import positions


def by_hand(rows, key):
    out, at = {}, {}
    for r in sorted(rows, key=key):
        out[r] = at.get(r[0], 0)
        at[r[0]] = out[r] + 1
    return out, at


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_in_hot_groups_with_nulls(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    first = lambda v: (v is not None, v or 0)  # noqa: E731 - nulls first
    want, sizes = by_hand(rows, lambda r: ((r[0] is not None, r[0] or ""), first(r[1]), r[2]))
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = positions(df, ["v", "id"], ["g"], "place", "size", partitions=parts).collect()
    assert {(r.g, r.v, r.id): r.place for r in got} == want
    assert all(r["size"] == sizes[r.g] for r in got)


def test_positions_without_groups_descending_and_empty(spark):
    rows = [(i * 37 % 101,) for i in range(101)]
    df = spark.createDataFrame(rows, "v int").repartition(5)
    got = positions(df, [F.desc("v")], partitions=4).collect()
    assert {r.v: r.position for r in got} == {v: 100 - v for v in range(101)}
    assert positions(df.filter("v < 0"), ["v"], partitions=4).count() == 0


def test_ties_get_different_places(spark):
    df = spark.createDataFrame([(1,)] * 500, "v int").repartition(4)
    got = positions(df, ["v"], partitions=4).collect()
    assert sorted(r.position for r in got) == list(range(500))
