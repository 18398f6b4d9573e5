"""Versioned snapshots (S13-S17, V7): each load is a ``version=<ts>``
partition of one Parquet dataset, so reading one version prunes all others
and listing versions is a ``groupBy(version)`` over partition values.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def version_id(now: _dt.datetime | None = None) -> str:
    """Backup name from a timestamp (ISO, ``:`` and ``.`` -> ``-``)."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return re.sub(r"[:.]", "-", now.strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """Append one version partition (dynamic partition overwrite, so a
    re-run of the same version replaces only that partition)."""
    (df.withColumn("version", F.lit(version)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(root))


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All versions; the partition value is kept as text (type inference
    would turn ``2025-01-03`` into a date)."""
    inferred = spark.read.parquet(root).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "version" else f for f in inferred])
    return spark.read.schema(schema).parquet(root)


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """S17 read side: one version (partition pruning on ``version``)."""
    return read_snapshots(spark, root).filter(F.col("version") == version)


def version_list(snapshots: DataFrame, keep: int | None = None) -> DataFrame:
    """S16 + O11: per version the bug, sprint and developer counts, rank by
    recency, ``active`` = newest; with ``keep`` also the retention flag (S15)."""
    g = snapshots.groupBy(F.col("version").cast("string").alias("version")).agg(
        F.count(F.lit(1)).alias("bugs"),
        F.count_distinct("sprint").alias("sprints"),
        F.count_distinct("assignee").alias("developers"),
    )
    w = Window.orderBy(F.desc("version"))
    g = g.withColumn("rank", F.row_number().over(w)).withColumn("active", F.col("rank") == 1)
    if keep is not None:
        g = g.withColumn("retain", F.col("rank") <= keep)
    return g


def versions_to_drop(snapshots: DataFrame, keep: int = 2) -> list[str]:
    """Version ids beyond the newest ``keep`` (a list of partition
    names: bounded by the number of versions, not rows)."""
    vs = version_list(snapshots, keep).filter(~F.col("retain")).select("version").collect()
    return [r.version for r in vs]


def drop_versions(spark: SparkSession, root: str, versions: list[str]) -> None:
    """Delete retired partitions through the Hadoop FileSystem API."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for v in versions:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/version={v}")
        p.getFileSystem(conf).delete(p, True)


def switch_version(spark: SparkSession, root: str, current_path: str, version: str) -> DataFrame:
    """Back up the current table as a new version, then make the chosen
    version the current table."""
    if not read_version(spark, root, version).take(1):
        raise ValueError(f"unknown or empty version {version!r}")
    cur = spark.read.parquet(current_path)
    write_snapshot(cur, root, version_id())
    chosen = read_version(spark, root, version).drop("version")
    chosen.write.mode("overwrite").parquet(current_path)
    return spark.read.parquet(current_path)


def source_info(log: DataFrame) -> DataFrame:
    """The latest load-metadata record (``max_by`` over load time)."""
    return log.agg(F.max_by(F.struct(*log.columns), F.col("load_timestamp")).alias("latest")).select("latest.*")
