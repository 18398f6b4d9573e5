"""T3 keeps a bounded state and drops no signal: late ones are a side table and settled at read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from defectlens.plans.q_io import ALERT_RULES
from defectlens.streaming import cooldown as CD
from defectlens.streaming import jobs as J
from tests.test_streaming import SIGNALS, _by_hand

BASE = dt.datetime(2024, 1, 1)


def write_files(spark, rows, d, files):
    """rows: (file, event); one Parquet file each, in the order of modification times."""
    df = spark.createDataFrame([(f, *r) for f, r in rows], "file int, " + SIGNALS)
    for f in files:
        df.filter(F.col("file") == f).drop("file").coalesce(1).write.mode("append").parquet(d["src"])


def start(spark, d, **options):
    stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(d["src"])
    return J.cooldown_stream(spark, stream, d["table"], d["ckpt"], ALERT_RULES, **options)


def alerts_of(rows):
    return {(r.rule, r.key, r.alert_ts): r.suppressed for r in rows}


def test_late_signals_are_counted_and_settled(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        file = rng.randrange(8)
        late = rng.random() < 0.15
        second = max(0, file * 40_000 + rng.randrange(40_000) - (rng.randrange(200_000) if late else 0))
        rows.append((file, (k, BASE + dt.timedelta(seconds=second), rng.randrange(3), rng.choice(["error", "signup"]), 0.0, "")))
    rows.append((0, (601, BASE, None, "error", 0.0, "")))
    events = [r for _, r in rows]
    d = J.new_dirs(spark, "t3-late")
    write_files(spark, rows, d, range(8))
    J.run_to_completion(start(spark, d, lateness="40000 seconds", state_partitions=2))
    signals = J.rule_signals(spark.createDataFrame(events, SIGNALS), ALERT_RULES)
    late = CD.late_signals(spark, d["table"]).collect()
    assert late and all(r.ts is not None for r in late)
    settled = alerts_of(CD.settled_alerts(spark, d["table"], signals, J.rule_cooldowns(ALERT_RULES)).collect())
    assert settled == _by_hand(events, ALERT_RULES)
    whole = alerts_of(CD.resolve_signals(signals, J.rule_cooldowns(ALERT_RULES)).collect())
    assert whole == settled
    # no signal is lost: every one is in an alert or in the side table
    current = CD.current_alerts(spark, d["table"]).collect()
    outside = sum(r.signals for r in late) + sum(r.suppressed + 1 for r in current) - len(events)
    assert 0 <= outside <= sum(r.signals for r in late)


def test_state_is_flat_over_100_batches(spark):
    """One hot key with 20 signals an hour: the state holds those of the lateness, however long the stream runs."""
    files = 100
    rows = [(f, (f * 20 + i, BASE + dt.timedelta(hours=f, seconds=180 * i), 7, "error", 0.0, "")) for f in range(files) for i in range(20)]
    rows += [(f, (5000 + f, BASE + dt.timedelta(hours=f), 1000 + f, "error", 0.0, "")) for f in range(files)]  # keys seen once
    d = J.new_dirs(spark, "t3-flat")
    df = spark.createDataFrame([(f, *r) for f, r in rows], "file int, " + SIGNALS)
    path = d["src"]
    df.repartitionByRange(files, "file").sortWithinPartitions("ts").drop("file").write.parquet(path)
    # files of one write have near modification times; their names are in file order, so give them their order
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        fs.setTimes(hadoop.Path(name), 1_700_000_000_000 + i * 1000, -1)
    query = start(spark, d, lateness="3 hours", state_partitions=1)
    J.run_to_completion(query)
    assert spark.read.parquet(d["table"]).select("epoch").distinct().count() >= files
    state = (spark.read.format("statestore").option("path", d["ckpt"]).option("stateVarName", "open").load()
             .select(F.length("value.times").alias("bytes")).collect())
    assert len(state) <= 8  # the hot key and those of the last hours
    assert max(r.bytes for r in state) <= 8 * 20 * 6
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 40
    assert CD.late_signals(spark, d["table"]).count() == 0
    events = [r for _, r in rows]
    assert alerts_of(CD.current_alerts(spark, d["table"]).collect()) == _by_hand(events, ALERT_RULES)


@pytest.mark.parametrize("rows", [[], [(1, None, None, "error", 0.0, ""), (2, None, None, "error", 0.0, ""), (3, BASE, None, "signup", 0.0, "")]])
def test_resolve_nulls_and_empty(spark, rows):
    signals = J.rule_signals(spark.createDataFrame(rows, SIGNALS), ALERT_RULES)
    got = alerts_of(CD.resolve_signals(signals, J.rule_cooldowns(ALERT_RULES)).collect())
    assert got == ({} if not rows else {("error-events", None, None): 1, ("signup-events", None, BASE): 0})
