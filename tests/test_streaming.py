"""Structured Streaming jobs: the final table equals the batch result."""

import datetime as dt
import time

from defectlens import config as C
from defectlens.operators import rollups as R
from defectlens.plans.q_io import ALERT_RULES
from defectlens.sources.adapter import Tables
from defectlens.streaming import jobs as J
from tests.conftest import SF_SMALL


def _rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_t1_stream_equals_batch(spark):
    t = Tables(spark, SF_SMALL)
    d = J.new_dirs(spark, "t1-test")
    J.write_for_replay(t.issues, d["src"])
    q = J.sprint_rollup_stream(spark, d["src"], spark.read.parquet(d["src"]).schema, d["sink"], d["ckpt"],
                               max_files=2)
    J.run_to_completion(q)
    got = spark.read.parquet(d["sink"])
    assert _rows(got, ["sprint"]) == _rows(R.issues_by_sprint(t.issues), ["sprint"])


SIGNALS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _by_hand(rows, rules):
    """Alerts worked out one signal at a time."""
    out = {}
    for rule, event_type, severity in rules:
        step = dt.timedelta(seconds=C.ALERT_COOLDOWN[severity])
        for key in {r[2] for r in rows}:
            times = [r[1] for r in rows if r[2] == key and r[3] == event_type]
            last = None
            for t in sorted(x for x in times if x is not None):
                if last is None or t >= last + step:
                    last = t
                    out[rule, key, t] = -1
                out[rule, key, last] += 1
            if None in times:
                out[rule, key, None] = times.count(None) - 1
    return out


def test_t3_cooldown_runs_from_the_last_alert(spark):
    """Across full hours, over several micro-batches, with both severities and signals without a time."""
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    rows = [(1, at(3599), 7, "error", 0.0, ""), (2, at(3601), 7, "error", 0.0, ""), (3, at(7198), 7, "error", 0.0, ""),
            (4, at(7199), 7, "error", 0.0, ""), (5, at(7300), 7, "signup", 0.0, ""), (6, at(11000), 7, "signup", 0.0, ""),
            (7, at(14500), 7, "signup", 0.0, ""), (8, None, 8, "error", 0.0, ""), (9, None, 8, "error", 0.0, ""),
            (10, at(5), 8, "error", 0.0, ""), (11, at(20000), 7, "error", 0.0, ""), (12, at(20000), 7, "error", 0.0, "")]
    d = J.new_dirs(spark, "t3-test")
    for part in (rows[:5], rows[5:9], rows[9:]):
        spark.createDataFrame(part, SIGNALS).coalesce(1).write.mode("append").parquet(d["src"])
        time.sleep(1.1)  # files are taken by modification time
    stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(d["src"])
    J.run_to_completion(J.cooldown_stream(spark, stream, d["table"], d["ckpt"], ALERT_RULES))
    got = {(r.rule, r.key, r.alert_ts): r.suppressed for r in J.current_alerts(spark, d["table"]).collect()}
    assert got == _by_hand(rows, ALERT_RULES)
    assert got["error-events", 7, at(3599)] == 2 and ("error-events", 7, at(7199)) in got


def test_t2_dimension_error_is_not_a_first_batch(spark):
    d = J.new_dirs(spark, "t2-test")
    assert not J.path_exists(spark, d["dim"])
    J._write_epoch(spark.createDataFrame([("Sprint 1", 1)], "sprint string, sprint_num int"), d["dim"], 0)
    assert J.path_exists(spark, d["dim"])


def test_epoch_sink_is_idempotent(spark):
    """A replayed micro-batch overwrites its own epoch only."""
    d = J.new_dirs(spark, "epoch-test")
    b0 = spark.createDataFrame([("Sprint 1", 1)], "sprint string, sprint_num int")
    b1 = spark.createDataFrame([("Sprint 2", 2), ("Sprint 3", 3)], "sprint string, sprint_num int")
    J._write_epoch(b0, d["table"], 0)
    J._write_epoch(b1, d["table"], 1)
    J._write_epoch(b1, d["table"], 1)          # replay of epoch 1
    assert J.read_epochs(spark, d["table"]).count() == 3
    assert J.read_latest_epoch(spark, d["table"]).count() == 2
    assert [r.sprint for r in J.read_latest_epoch(spark, d["table"], before=1).collect()] == ["Sprint 1"]
