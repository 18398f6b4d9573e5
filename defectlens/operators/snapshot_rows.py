"""V7 by rows: what was added, removed or changed between two snapshots.

A snapshot is written with its rows dealt into buckets (a partition column)
and, beside it, one fingerprint row a bucket: the number of rows and two
order-free sums of their hashes.  To compare two snapshots, the fingerprints
are joined; only the rows of buckets whose fingerprints differ are read (the
bucket list prunes folders) and joined in full by key.  If the buckets follow
what changes together, here the sprint, a day's edits touch few of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(*columns: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a row by the columns that change together (null: a value like others)."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _row_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """64-bit hash of a row; nulls are told from empty values by their own bits."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def once_per_key(df: DataFrame, key: str, path: str, bucket: Column) -> DataFrame:
    """One row per ``key`` with the least value of each other column, written in bucket folders at ``path`` and read again.

    Only the keys are counted over all rows.  The rows of keys that repeat
    (nulls are one key) are aggregated; the others are as they are.
    """
    twice = f"{path}-repeated"
    df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_key")).write.parquet(twice)
    repeated = df.sparkSession.read.parquet(twice)
    same = F.col(key).eqNullSafe(F.col("_key"))
    least = df.join(repeated, same, "left_semi").groupBy(key).agg(*[F.min(c).alias(c) for c in df.columns if c != key])
    rows = df.join(repeated, same, "left_anti").unionByName(least)
    _in_buckets(rows, bucket).write.partitionBy("bucket").parquet(path)
    return df.sparkSession.read.parquet(path).drop("bucket")


def _in_buckets(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn("bucket", bucket).hint("rebalance", "bucket")  # splits a hot bucket


def write_snapshot(df: DataFrame, root: str, version: str, bucket: Column, dealt: bool = False) -> None:
    """Rows of ``version`` in bucket folders, then their fingerprints (which make the snapshot whole).

    ``dealt``: ``df`` is read from folders of nearly the same buckets, so that
    its tasks hold few of them each and need no shuffle.
    """
    columns = sorted(df.columns)
    path = f"{root}/rows/version={version}"
    (df.withColumn("bucket", bucket) if dealt else _in_buckets(df, bucket)).write.partitionBy("bucket").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    total = lambda seed: F.sum(_row_hash(columns, seed).cast("decimal(38,0)"))
    rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).coalesce(1) \
        .write.parquet(f"{root}/fingerprints/version={version}")


def read_snapshot(spark: SparkSession, root: str, version: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of a snapshot, of the given buckets only."""
    rows = spark.read.parquet(f"{root}/rows/version={version}")
    return rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))


def differing_buckets(spark: SparkSession, root: str, old: str, new: str) -> list[int]:
    """Buckets whose fingerprints differ: at most one number a bucket."""
    a, b = (spark.read.parquet(f"{root}/fingerprints/version={v}").select("bucket", F.struct("n", "a", "b").alias(f"f{i}"))
            for i, v in enumerate((old, new)))
    return sorted(r.bucket for r in a.join(b, "bucket", "full_outer").filter(~F.col("f0").eqNullSafe(F.col("f1"))).select("bucket").collect())


def _paired(df: DataFrame, key: list[str], columns: list[str], side: str) -> DataFrame:
    """Rows with their place among equal keys (in hash order), so that repeated keys pair up one to one."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(_row_hash(columns)))
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], place.alias("_place"),
                     F.struct(*columns).alias(side))


def row_diff(spark: SparkSession, root: str, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """Rows that differ: the key, change (added, removed, changed), and for changed rows ``changes``:
    array of (column, before, after) as text, in the order of the columns' names.

    A column that only one snapshot has counts as changed where its value is
    not null.  A key that moved to another bucket is one changed row, as both
    buckets differ.  Repeated keys pair up in the order of their row hashes.
    """
    buckets, key = differing_buckets(spark, root, old, new), list(key)
    a, b = (read_snapshot(spark, root, v, buckets).drop("bucket") for v in (old, new))
    columns = sorted((set(a.columns) | set(b.columns)) - set(key))

    def shaped(df: DataFrame) -> DataFrame:
        missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
        return df.withColumns(missing) if missing else df

    x, y = _paired(shaped(a), key, columns, "_old"), _paired(shaped(b), key, columns, "_new").alias("n")
    same = F.col("o._place") == F.col("n._place")
    for i in range(len(key)):
        same = same & F.col(f"o._k{i}").eqNullSafe(F.col(f"n._k{i}"))
    both = x.alias("o").join(y, same, "full_outer")
    text = lambda c: c.cast("string")
    changes = F.array_compact(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.struct(
        F.lit(c).alias("column"), text(F.col(f"_old.{c}")).alias("before"), text(F.col(f"_new.{c}")).alias("after"))) for c in columns]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size("_c") > 0, "changed")
    none = F.lit(None).cast("array<struct<column:string,before:string,after:string>>")
    return (both.withColumn("_c", changes).withColumn("change", change).filter(F.col("change").isNotNull())
            .select(*[F.coalesce(f"o._k{i}", f"n._k{i}").alias(c) for i, c in enumerate(key)], "change",
                    F.when(F.col("change") == "changed", F.col("_c")).otherwise(none).alias("changes")))
