"""T3 alert cooldown with bounded state: watermark, timers and a side table for late signals.

After an alert its (rule, key) is silent for the cooldown of its severity; the
next signal at or after that raises a new one.  Signals may come in any order
within ``lateness`` of the newest one seen (the stream's watermark).  A key's
state is its last settled alert with the signals counted to it, and the
distinct times of signals above the watermark; a timer settles them when the
watermark passes and drops the state of a key that is silent and out of its
cooldown.  So the state follows the signals of the last ``lateness``, not the
stream's age.

Each micro-batch logs the alerts that a key's unsettled signals raise; they
replace the key's rows of earlier micro-batches from ``since`` on.  Signals
below the watermark are not dropped: they are logged as late, counted at read
to the alert whose cooldown they fall into, and ``settled_alerts`` resolves
the keys that have any again from the signals themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How much later than the newest signal a signal may come and still be placed in order.
LATENESS = "7 days"

LOG = ("rule string, key bigint, alert_ts timestamp_ntz, signals bigint, since timestamp_ntz, cooldown bigint, late boolean")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def alert_signals(events: DataFrame, signal_type: str = "error", rule: str = "error-events") -> DataFrame:
    """T3 input: events of the signal type as alert signals keyed by user."""
    ts = F.col("ts")
    # Event time as an instant read from the wall-clock fields as UTC, so the
    # windows do not depend on the session time zone (watermarks need TIMESTAMP).
    instant = F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                               F.date_format(ts, "ss.SSSSSS").cast("decimal(8,6)"), F.lit("UTC"))
    return events.filter(F.col("event_type") == signal_type).select(
        F.lit(rule).alias("rule"), F.col("user_id").alias("key"), instant.alias("ts"),
        ts.alias("ts_local"), F.col("event_id"), F.unix_micros(instant).alias("micros"))


def rule_signals(events: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Signals of all rules (rule, event type, severity); an event may feed several."""
    out = None
    for rule, event_type, _severity in rules:
        one = alert_signals(events, event_type, rule)
        out = one if out is None else out.unionByName(one)
    return out


def _resolver():
    """``raised``: alerts of sorted distinct times that go on from a last alert."""
    import numpy as np

    def raised(last, signals, times, counts, step):
        """(alert time, signals counted to it), the last alert first if there is one."""
        total, at, alerts = np.concatenate([[0], np.cumsum(counts)]), 0, []
        if last is not None:
            at = int(np.searchsorted(times, last + step))
            alerts.append((last, signals + int(total[at])))
        while at < len(times):
            first = int(times[at])
            end = int(np.searchsorted(times, first + step))
            alerts.append((first, int(total[end] - total[at])))
            at = end
        return alerts

    return raised


def _processor(seconds: dict[str, int]):
    """The stateful processor; made inside so that it travels to the workers by value."""
    from collections import Counter
    from datetime import datetime, timedelta

    import numpy as np
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    raised, start, columns = _resolver(), datetime(1970, 1, 1), [c.split()[0] for c in LOG.split(", ")]
    log = Row(*columns)

    def stamp(us):
        return start + timedelta(microseconds=us)

    class Cooldown(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.open = handle.getValueState("open", "last bigint, signals bigint, times binary, counts binary, timer bigint")

        def _held(self):
            """(last, signals, times, counts, timer) of the key; the timer is null without a state."""
            held = self.open.get()
            if held is None:
                return None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), None
            last, signals, times, counts, timer = held
            return last, signals, np.frombuffer(times, np.int64), np.frombuffer(counts, np.int64), timer

        def _settle(self, held, horizon, step, fired=False):
            """Keep what the watermark has not passed; a timer for when it will."""
            last, signals, times, counts, timer = held
            k = int(np.searchsorted(times, horizon))
            for alert in raised(last, signals, times[:k], counts[:k], step):
                last, signals = alert
            times, counts = times[k:], counts[k:]
            ends = [int(times[-1])] if len(times) else []
            if last is not None and last + step > horizon:
                ends.append(last + step)
            due = max(ends) // 1000 + 1 if ends else None
            if due != timer or fired:
                if timer is not None and not fired:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
            if due is not None:
                self.open.update((last, signals, times.tobytes(), counts.tobytes(), due))
            elif timer is not None:
                self.open.clear()

        @staticmethod
        def _horizon(timerValues):
            ms = timerValues.getCurrentWatermarkInMs()
            return ms * 1000 if ms > 0 else -(1 << 62)

        def handleInputRows(self, key, rows, timerValues):
            rule, user = key
            step, horizon = seconds[rule] * 1_000_000, self._horizon(timerValues)
            seen = Counter(r.micros for r in rows)  # equal times are one entry with a count
            untimed = seen.pop(None, 0)
            times = np.array(sorted(seen), np.int64)
            counts = np.array([seen[t] for t in times.tolist()], np.int64)
            k = int(np.searchsorted(times, horizon))
            for t, n in zip(times[:k].tolist(), counts[:k].tolist()):
                yield log(rule, user, stamp(t), n, None, seconds[rule], True)
            if k < len(times):
                last, signals, old, held, timer = self._held()
                t, at = np.unique(np.concatenate([old, times[k:]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held, counts[k:]]), len(t)).astype(np.int64)
                alerts = raised(last, signals, t, n, step)
                since = stamp(alerts[0][0])
                self._settle((last, signals, t, n, timer), horizon, step)
                for a, c in alerts:
                    yield log(rule, user, stamp(a), c, since, seconds[rule], False)
            if untimed:
                yield log(rule, user, None, untimed, None, seconds[rule], False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self._settle(self._held(), self._horizon(timerValues), seconds[key[0]] * 1_000_000, fired=True)
            return iter(())

        def close(self):
            pass

    return Cooldown()


def cooldown_alerts(signals: DataFrame, cooldowns: dict[str, int], lateness: str = LATENESS) -> DataFrame:
    """Signals to the log rows of the alerts they raise or are suppressed by.

    The watermark is taken from ``ts``; the operator sees the times as plain
    numbers, so Spark hands it late signals too instead of dropping them.
    Signals without a time form one alert of their own, which only grows.
    """
    marked = signals.withWatermark("ts", lateness).select("rule", "key", "micros")
    return marked.groupBy("rule", "key").transformWithState(_processor(dict(cooldowns)), LOG, "Update", "EventTime")


def _log(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).withColumn("epoch", F.col("epoch").cast("long"))


def late_signals(spark: SparkSession, table: str) -> DataFrame:
    """The side table: signals below the watermark when they came (rule, key, ts, signals)."""
    return _log(spark, table).filter("late").groupBy("rule", "key", F.col("alert_ts").alias("ts")).agg(F.sum("signals").alias("signals"))


def current_alerts(spark: SparkSession, table: str) -> DataFrame:
    """The T3 log resolved: one row an alert with the signals it suppressed.

    Rows that a later epoch resolved again are left out; late signals count to
    the alert whose cooldown they fall into (others raise nothing here, see
    ``settled_alerts``)."""
    later = Window.partitionBy("rule", "key").orderBy("epoch").rangeBetween(1, Window.unboundedFollowing)
    log = _log(spark, table).withColumn("again", F.min("since").over(later))
    valid = log.filter(F.col("late") | F.col("alert_ts").isNull() | F.col("again").isNull() | (F.col("alert_ts") < F.col("again")))
    before = Window.partitionBy("rule", "key").orderBy("alert_ts", "late").rowsBetween(Window.unboundedPreceding, 0)
    placed = valid.withColumn("_of", F.last(F.when(~F.col("late"), F.col("alert_ts")), ignorenulls=True).over(before))
    inside = F.col("alert_ts") < F.col("_of") + F.make_dt_interval(secs=F.col("cooldown"))
    placed = placed.filter(~F.col("late") | inside).withColumn("alert_ts", F.when(F.col("late"), F.col("_of")).otherwise(F.col("alert_ts")))
    return placed.groupBy("rule", "key", "alert_ts").agg((F.sum("signals") - 1).cast("long").alias("suppressed"))


def resolve_signals(signals: DataFrame, cooldowns: dict[str, int]) -> DataFrame:
    """The alerts of a whole table of signals (rule, key, micros), in one sorted pass.

    Equal times are counted before the shuffle; a task reads its keys' times
    in order and holds one open alert, so a key's length does not matter to
    memory.
    """
    import pandas as pd

    seconds = dict(cooldowns)

    def walk(batches):
        rule = key = last = count = None
        done = []
        for b in batches:
            for r, k, t, n in zip(b["rule"], b["key"], b["micros"], b["n"]):
                t, k = (None if pd.isna(t) else int(t)), (None if pd.isna(k) else int(k))
                if count is not None and (r, k) == (rule, key) and (t == last or None not in (t, last) and t < last + seconds[r] * 1_000_000):
                    count += int(n)
                    continue
                if count is not None:
                    done.append((rule, key, last, count - 1))
                rule, key, last, count = r, k, t, int(n)
            yield frame(done)
            done = []
        yield frame([(rule, key, last, count - 1)] if count is not None else [])

    def frame(rows):
        out = pd.DataFrame(rows, columns=["rule", "key", "alert_ts", "suppressed"]).astype({"key": "Int64", "alert_ts": "Int64"})
        out["alert_ts"] = pd.to_datetime(out["alert_ts"], unit="us")
        return out

    counted = signals.groupBy("rule", "key", "micros").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartition("rule", "key").sortWithinPartitions("rule", "key", "micros")
    return ordered.mapInPandas(walk, "rule string, key bigint, alert_ts timestamp_ntz, suppressed bigint")


def settled_alerts(spark: SparkSession, table: str, signals: DataFrame, cooldowns: dict[str, int]) -> DataFrame:
    """``current_alerts``, the keys with late signals resolved again from ``signals`` (all that the stream read)."""
    late = _log(spark, table).filter("late").select("rule", "key").distinct()
    same = lambda a, b: a["rule"].eqNullSafe(b["rule"]) & a["key"].eqNullSafe(b["key"])
    current = current_alerts(spark, table)
    kept = current.join(late, same(current, late), "left_anti")
    again = signals.select("rule", "key", "micros")
    return kept.unionByName(resolve_signals(again.join(late, same(again, late), "left_semi"), cooldowns))
