"""The alert stream equals the batch result whatever files and micro-batches its signals come in."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from defectlens.plans.q_io import ALERT_RULES
from defectlens.streaming import jobs as J
from tests.test_streaming import SIGNALS, _by_hand


@pytest.mark.parametrize("files,max_files", [(J.FILES_PER_TRIGGER + 4, J.FILES_PER_TRIGGER), (9, 2)])
def test_interleaved_times_over_several_micro_batches(spark, files, max_files):
    rng = random.Random(files)
    base = dt.datetime(2024, 1, 1)
    rows = [(k, None if rng.random() < 0.02 else base + dt.timedelta(seconds=rng.randrange(200_000)), rng.randrange(4),
             rng.choice(["error", "signup", "view"]), 0.0, "") for k in range(1500)]
    d = J.new_dirs(spark, "t3-order")
    (spark.createDataFrame(rows, SIGNALS).withColumn("file", F.col("event_id") % files)
     .repartitionByRange(files, "file").drop("file").write.parquet(d["src"]))
    stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", max_files).parquet(d["src"])
    J.run_to_completion(J.cooldown_stream(spark, stream, d["table"], d["ckpt"], ALERT_RULES))
    got = J.current_alerts(spark, d["table"]).collect()
    assert spark.read.parquet(d["table"]).select("epoch").distinct().count() > 1
    assert len(got) == len({(r.rule, r.key, r.alert_ts) for r in got})
    assert {(r.rule, r.key, r.alert_ts): r.suppressed for r in got} == _by_hand(rows, ALERT_RULES)
