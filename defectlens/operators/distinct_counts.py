"""Mergeable exact distinct counts (A7, A22, A23, A27, S16): bitmaps over dictionary ids.

``count(DISTINCT x)`` cannot be added up over groups, and several of them in
one aggregate expand every row.  Here the values get dense ids once; the
lowest roll-up stores, per group and range of ids, a bitmap of the ids seen.
Any coarser group's count is the number of bits in the OR of its bitmaps: one
aggregate over the roll-up, no rows expanded, no second scan of the issues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens.operators.numbering import positions


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with ids 1, 2... in their order; null and blank have none."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    return positions(values, ["value"], column="id").withColumn("id", F.col("id") + 1)


def bitmap_rollup(df: DataFrame, by: list[str], column: str, ids: DataFrame) -> DataFrame:
    """(by, range, bits, rows): ids of ``column`` seen in each group, one bitmap a range of ids.

    ``ids`` is joined by value (its size is measured).  Rows whose value has
    no id keep their group, in range 0 without bits, so that ``rows`` adds up.
    """
    marked = df.select(*by, F.col(column).alias("_value")).join(ids.withColumnRenamed("value", "_value"), "_value", "left")
    at = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.bitmap_bucket_number("id")).alias("range")
    return marked.groupBy(*by, at).agg(
        F.bitmap_construct_agg(F.when(F.col("id").isNotNull(), F.bitmap_bit_position(F.col("id")))).alias("bits"),
        F.count(F.lit(1)).alias("rows"))


def distinct_counts(rollup: DataFrame, by: list[str], name: str = "distinct") -> DataFrame:
    """Distinct values and rows of coarser (or the same) groups of a bitmap roll-up."""
    merged = rollup.groupBy(*by, "range").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"))
    seen = F.when(F.col("range") > 0, F.bitmap_count("bits")).otherwise(F.lit(0))
    return merged.groupBy(*by).agg(F.sum(seen).cast("long").alias(name), F.sum("rows").cast("long").alias("rows"))
