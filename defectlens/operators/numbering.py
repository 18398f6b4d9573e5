"""Positions in a total order without one task (N5, O9): two passes.

An unpartitioned ``row_number`` sends every row to one task, and a partitioned
one sends a hot group there.  Here the rows are range-partitioned by (group,
order) and written once; a row's number is its index in its range partition
less the index of its group's first row there, plus the rows that its group
has in earlier partitions.  Only the counts (one row per range partition and
group that touches it) are summed up in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlens.session import scratch_path

#: ``monotonically_increasing_id`` holds the partition above this many bits.
_ROW_BITS = 33


def _sorted_copy(df: DataFrame, keys: list[Column], partitions: int | None) -> DataFrame:
    """``df`` in range partitions of ``keys``, written with each row's ``_part`` and ``_row``."""
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    path = scratch_path(spark, "positions")
    ranged.write.parquet(path)
    return (spark.read.schema(ranged.schema).parquet(path)
            .withColumn("_part", F.shiftright("_at", _ROW_BITS))
            .withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_at"))


def positions(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), column: str = "position",
              total: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based place by ``order`` inside its ``by`` group.

    Nulls come first as in Spark's ascending order; a null group is a group.
    Rows that tie in every column of ``order`` get different places in a fixed
    but unstated order, so give a last column that settles ties where it
    matters.  ``total`` names a column for the group's number of rows.  The
    input should be cheap to scan twice (the range bounds are sampled first).
    An empty table stays empty.
    """
    by, keys = list(by), [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    rows = _sorted_copy(df, keys, partitions)
    parts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_n").over(whole).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = rows.join(parts, same).withColumn(column, F.col("_row") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_row", "_of", "_shift", "_total", *[f"_by{i}" for i in range(len(by))])
