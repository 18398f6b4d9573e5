"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: anything
that must be written (lineage cuts, snapshots, stream checkpoints) goes below
the shared folder named by ``spark.checkpoint.dir``.  Only when the setting is
absent (unit tests, a laptop) do we fall back to a fresh ``/tmp`` folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app: str = "defectlens", broadcast_bytes: int = 4 * 1024 * 1024) -> SparkSession:
    """Session tuned for the library: AQE on, UI off, UTC, Arrow on.

    Off a single machine the initial shuffle partitions are many; AQE merges
    the small ones, but would not cut large ones evenly.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans here are built from many Column calls; per-call Python call-site
        # capture costs a py4j round trip each, so it is off (errors still carry
        # the JVM-side context).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or (8 if master.startswith("local") else 4000)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only sides Spark measures below this size (static file
        # statistics, then AQE runtime statistics); the fact side must stay
        # the streamed side so its scan parallelism carries the join.
        .config("spark.sql.autoBroadcastJoinThreshold", str(broadcast_bytes))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="defectlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # pragma: no cover - Connect sessions have no SparkContext
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint dir (never reused)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "defectlens", f"{name}-{uuid.uuid4().hex[:12]}")
