"""Structured Streaming re-aims of the dashboard's refresh features.

T1  auto-refresh: issue files arriving in a folder -> the A1 sprint roll-up,
    kept current with ``complete`` output (state = one row per sprint).
T2  upload -> load -> rebuild: CSV files arriving in a folder are backed up
    as cells, read by their own headers (S1-S3, N4), appended to the issue
    table; roll-up and sprint dimension (S10) follow inside ``foreachBatch``.
T3  alert cooldown: events become alert signals; after an alert its
    (rule, key) is silent for the cooldown of its severity.  The state is
    bounded by the lateness allowed (``cooldown.py``).

All checkpoints and sinks live below ``spark.checkpoint.dir`` (shared
storage), so a restarted query resumes exactly-once from its offsets.  Tests
and the registered queries drive them with ``trigger(availableNow=True)``;
production uses ``trigger(processingTime=...)`` with the configured refresh.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlens import config as C
from defectlens.operators import rollups as R
from defectlens.session import scratch_path
from defectlens.sources import header_map as HM
from defectlens.sources.csv_source import sprint_dimension, upsert_dimension
from defectlens.streaming.cooldown import (LATENESS, ROCKSDB, alert_signals, cooldown_alerts, current_alerts, late_signals,  # noqa: F401
                                           rule_signals, settled_alerts)

#: Files of one micro-batch; fixed, so that a batch does not grow with the folder.
FILES_PER_TRIGGER = 16
REFRESH = f"{C.REFRESH_INTERVAL_MS // 1000} seconds"


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=REFRESH)


def _start(spark: SparkSession, writer, state_partitions: int | None, settings: dict[str, str] | None = None):
    """Start a query with ``state_partitions`` state-store partitions.

    A stateful query fixes its partition count from
    ``spark.sql.shuffle.partitions`` at first start and records it in the
    checkpoint, like other ``settings`` of its state; the session values are
    set only around ``start()`` and then restored.  Default: the cluster's
    parallelism (one partition per core).
    """
    n = state_partitions or spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.shuffle.partitions": str(n), **(settings or {})}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sprint_rollup_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink: str,
                         checkpoint: str, available_now: bool = True, max_files: int = 1,
                         state_partitions: int | None = None, rollup=R.issues_by_sprint, versioned: bool = False):
    """A1 (or another one-aggregate ``rollup``: A2, A8) over an issue file
    stream; each micro-batch overwrites the sink with the current roll-up
    (complete mode; state = the roll-up's groups).  ``versioned`` writes each
    roll-up as an epoch of its own and keeps the one before, so that a reader
    (``read_latest_epoch``) never finds the sink empty or half written."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir))
    agg = rollup(stream)

    def publish(batch: DataFrame, epoch: int) -> None:
        if not versioned:
            batch.write.mode("overwrite").parquet(sink)
            return
        _write_epoch(batch, sink, epoch)
        _drop_epochs(spark, sink, epoch - 1)

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return _start(spark, _trigger(w, available_now), state_partitions)


def _write_epoch(df: DataFrame, root: str, epoch: int) -> None:
    """Idempotent micro-batch sink: the batch lands in its own ``epoch=N``
    partition with dynamic overwrite, so a replayed epoch replaces exactly
    its own rows and never touches earlier epochs."""
    (df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(root))


def _landed_epoch(df: DataFrame, root: str, epoch: int) -> DataFrame | None:
    """``df`` written as an epoch and read again; None if it has no row."""
    _write_epoch(df, root, epoch)
    path = f"{root}/epoch={epoch}"
    return df.sparkSession.read.schema(df.schema).parquet(path) if path_exists(df.sparkSession, path) else None


def _drop_epochs(spark: SparkSession, root: str, before: int) -> None:
    """Delete the epochs of a versioned table that came before ``before``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("epoch=") and int(name[len("epoch="):]) < before:
            fs.delete(s.getPath(), True)


def read_epochs(spark: SparkSession, root: str) -> DataFrame:
    """All rows of an epoch-partitioned sink (the epoch column dropped)."""
    return spark.read.parquet(root).drop("epoch")


def read_latest_epoch(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest version of an epoch-versioned table (optionally the newest
    written before ``before``); the version is picked by a scalar subquery."""
    df = spark.read.parquet(root)
    if before is not None:
        df = df.filter(F.col("epoch") < before)
    latest = df.select(F.max("epoch")).scalar()
    return df.filter(F.col("epoch") == latest).drop("epoch")


def csv_ingest_stream(spark: SparkSession, source_dir: str, table: str, dim: str, checkpoint: str,
                      available_now: bool = True, max_files: int = 1, raw: str | None = None, rejected: str | None = None,
                      rollup: str | None = None):
    """CSV drop folder -> canonical issues appended to ``table``; the
    sprint dimension is upserted (S10) into a new version of ``dim`` per
    epoch.  Every file is read by its own header (``header_map``).

    A micro-batch is a list of files: they first land as cells in ``raw`` (the backup of the upload,
    parsed once), then its issues, the files rejected with their reason, its
    part of the sprint roll-up (A1; ``summed_rollup`` adds the parts up) and
    the dimension are written.  All sinks are epoch-partitioned and written
    idempotently, so a replayed batch after a failure neither duplicates
    issues nor loses dimension rows (the previous version stays intact until
    the next one is committed).  Sinks not named stand beside ``table``."""
    raw, rejected, rollup = raw or f"{table}_raw", rejected or f"{table}_rejected", rollup or f"{table}_rollup"

    def load(batch: DataFrame, epoch: int) -> None:
        files = HM.file_list(batch)
        rows = HM.land_cells(spark, files, lambda df: _landed_epoch(df, raw, epoch)) if files else None
        if rows is None:
            return  # no file of the batch has a row
        headers = HM.file_headers(rows, land=lambda df, name: _landed_epoch(df, f"{raw}_{name}", epoch))
        issues = _landed_epoch(HM.issues_of(rows, headers), table, epoch)
        _write_epoch(HM.rejected_files(headers), rejected, epoch)
        if issues is None:
            return  # all files rejected, or headers alone
        new_dim = sprint_dimension(_landed_epoch(R.issues_by_sprint(issues), rollup, epoch))  # a row a sprint
        # Only a table that does not exist yet is a first batch; any other error fails it.
        cur = read_latest_epoch(spark, dim, before=epoch) if path_exists(spark, dim) else None
        _write_epoch(upsert_dimension(cur, new_dim), dim, epoch)

    stream = HM.stream_files(spark, source_dir, max_files)
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return _trigger(w, available_now).start()


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    """Files that were not loaded: file, reason, header; none before the first."""
    empty = spark.createDataFrame([], "file string, reason string, header string")
    if not path_exists(spark, root):
        return empty
    return spark.read.schema("file string, reason string, header string, epoch long").parquet(root).drop("epoch")


def summed_rollup(spark: SparkSession, root: str) -> DataFrame:
    """A1 over all loads: the epochs' parts added up (their counts are sums)."""
    parts = read_epochs(spark, root)
    return parts.groupBy("sprint").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "sprint"])


def cooldown_stream(spark: SparkSession, stream: DataFrame, table: str, checkpoint: str, rules: list[tuple[str, str, str]],
                    available_now: bool = True, state_partitions: int | None = None, lateness: str = LATENESS):
    """T3 as a stream over events: ``rules`` are (rule, event type, severity);
    a severity's cooldown is the configured one.  Each micro-batch is written
    to its own epoch of the log ``table``."""
    alerts = cooldown_alerts(rule_signals(stream, rules), rule_cooldowns(rules), lateness)

    def append(batch: DataFrame, epoch: int) -> None:
        _write_epoch(batch, table, epoch)

    w = alerts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(append)
    return _start(spark, _trigger(w, available_now), state_partitions, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB})


def rule_cooldowns(rules: list[tuple[str, str, str]]) -> dict[str, int]:
    """Seconds of silence after an alert of each rule."""
    return {rule: C.ALERT_COOLDOWN[severity] for rule, _, severity in rules}


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table as a file stream, whether it is one file or a folder."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files or FILES_PER_TRIGGER)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)




def write_for_replay(df: DataFrame, out_dir: str) -> str:
    """Stream input for a frame that is no written table yet."""
    df.write.mode("overwrite").parquet(out_dir)
    return out_dir


def run_to_completion(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def new_dirs(spark: SparkSession, name: str) -> dict[str, str]:
    base = scratch_path(spark, name)
    return {k: os.path.join(base, k) for k in ("src", "sink", "ckpt", "table", "dim")}
