"""Upload chain with an atomic current version.

A load writes a new version folder: the issues, then the roll-ups rebuilt from
them.  Nothing a reader sees changes until the last step, one row in the
pointer log that names the version.  The version before it stays as it is, so
the backup of an upload costs no copy and switching back is another pointer
row.  A load that fails between its steps leaves the pointer, and readers go
on with the old rows; its folder is removed by the retention after a later
load.  The log and the versions are plain Parquet written by Spark jobs, so
each step is whole or absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlens.operators import rollups as R
from defectlens.sources.versions import version_id

#: Roll-ups rebuilt by each load, from its issues.
ROLLUPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "by_sprint": R.issues_by_sprint, "by_priority": R.issues_by_priority, "by_assignee": R.assignee_summary}

_LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("version", T.StringType()),
                     T.StructField("action", T.StringType()), T.StructField("moved_at", T.TimestampType())])


class Releases:
    """Versions of the issue table below ``root`` and the one that is current."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, rollups: dict | None = None):
        if keep < 1:
            raise ValueError("keep at least the current version")
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.rollups = ROLLUPS if rollups is None else rollups
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- folders ---------------------------------------------------------
    def _folders(self, name: str) -> list[str]:
        """Names below a folder: one a version, or one a move of the pointer."""
        p = self._path(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _done(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{folder}/_SUCCESS"))

    # -- readers ---------------------------------------------------------
    def log(self) -> DataFrame:
        """All moves of the pointer: seq, version, action, moved_at."""
        paths = [f"{self.root}/pointer/{f}" for f in self._folders("pointer") if self._done(f"pointer/{f}")]
        return self.spark.read.schema(_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], _LOG)

    def current_version(self) -> str | None:
        """The version that the last whole move names; one small row is read."""
        for f in reversed(self._folders("pointer")):
            if self._done(f"pointer/{f}"):
                return self.spark.read.schema(_LOG).parquet(f"{self.root}/pointer/{f}").first().version
        return None

    def versions(self) -> list[str]:
        """Versions on disk whose load came to its end, oldest first."""
        return [v for v in self._folders("versions") if self._done(f"versions/{v}/complete")]

    def _table(self, version: str | None, name: str) -> DataFrame:
        if version is None:
            raise ValueError("nothing was published yet")
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        """The current issues and roll-ups, all of one version."""
        version = self.current_version()
        return {"issues": self._table(version, "issues"), **{n: self._table(version, f"rollup_{n}") for n in self.rollups}}

    def issues(self, version: str | None = None) -> DataFrame:
        return self._table(version or self.current_version(), "issues")

    def rollup(self, name: str, version: str | None = None) -> DataFrame:
        return self._table(version or self.current_version(), f"rollup_{name}")

    def version_list(self) -> DataFrame:
        """S16 + O11: complete versions, newest first: rank, active, bugs, sprints, developers."""
        current = self.current_version()
        out = None
        for v in self.versions():  # ``keep`` of them after a load
            one = self.issues(v).agg(F.count(F.lit(1)).alias("bugs"), F.count_distinct("sprint").alias("sprints"),
                                     F.count_distinct("assignee").alias("developers")).withColumn("version", F.lit(v))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("nothing was published yet")
        newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("version"))  # one row a version
        return out.withColumn("rank", F.row_number().over(newest)).withColumn("active", F.col("version") == F.lit(current))

    # -- writers ---------------------------------------------------------
    def publish(self, issues: DataFrame, version: str | None = None) -> str:
        """Load ``issues`` as a new version, rebuild its roll-ups, make it current, retire old versions."""
        version = version or version_id()
        if version in self._folders("versions"):
            raise ValueError(f"version {version!r} exists")
        folder = f"{self.root}/versions/{version}"
        issues.write.parquet(f"{folder}/issues")
        loaded = self.spark.read.parquet(f"{folder}/issues")
        for name, build in self.rollups.items():
            build(loaded).write.parquet(f"{folder}/rollup_{name}")
        self._one_row(_LOG, (0, version, "complete", None)).write.parquet(f"{folder}/complete")
        self._move(version, "load")
        self._retire(version)
        return version

    def switch(self, version: str) -> None:
        """Make a complete version current; the one before stays as its backup."""
        if version not in self.versions():
            raise ValueError(f"unknown or incomplete version {version!r}")
        self._move(version, "switch")

    def _one_row(self, schema: T.StructType, row: tuple) -> DataFrame:
        return self.spark.createDataFrame([row], schema).coalesce(1)

    def _move(self, version: str, action: str) -> None:
        """One new row after all others; of two writers at once the second fails, as its folder exists."""
        moves = self._folders("pointer")
        seq = int(moves[-1]) + 1 if moves else 0
        row = self._one_row(_LOG, (seq, version, action, None)).withColumn("moved_at", F.current_timestamp())
        row.write.mode("errorifexists").parquet(f"{self.root}/pointer/{seq:012d}")

    def _retire(self, current: str) -> None:
        """S15, after the pointer moved: the current version and the newest others stay; older and broken ones go."""
        whole = [v for v in self.versions() if v != current]
        kept = {current, *sorted(whole)[len(whole) - (self.keep - 1):]} if self.keep > 1 else {current}
        for v in self._folders("versions"):
            if v not in kept and (v in whole or v < current):  # a load that runs now has a later name
                self._fs.delete(self._path(f"{self.root}/versions/{v}"), True)
