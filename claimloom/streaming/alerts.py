"""Alerts as a stream: minutes are folded by an aggregation, and a small keyed state follows them minute by minute."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALERT = "alert string, severity string, fired_at timestamp"
ERROR_WINDOW = 5


class Watch(StatefulProcessor):
    """Evaluates every minute once: when the minutes before it are closed, whether rows came for them or only time went by.

    State holds the minutes a window can reach back to, the last evaluation, and for how many evaluations in a row each condition held.
    """

    def __init__(self, max_error_rate: float, error_minutes: int, idle_minutes: int, idle_for: int):
        self.max_error_rate, self.error_minutes, self.idle_minutes, self.idle_for = max_error_rate, error_minutes, idle_minutes, idle_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "processed long, errors long")
        self.now = handle.getValueState("now", "at long, high int, idle int")

    def _advance(self, upto: int, counts: dict[int, tuple[int, int]]) -> pd.DataFrame:
        """Evaluations after the last one up to ``upto``, from the counts of the minutes before them."""
        at, high, idle = self.now.get()
        fired = []
        while at + 60 <= upto:
            at += 60
            errors = sum(counts.get(at - 60 * i, (0, 0))[1] for i in range(1, ERROR_WINDOW + 1))
            done = sum(counts.get(at - 60 * i, (0, 0))[0] for i in range(1, self.idle_minutes + 1))
            high = high + 1 if errors / (60 * ERROR_WINDOW) > self.max_error_rate else 0
            idle = idle + 1 if not done else 0
            if high > self.error_minutes:
                fired.append(("HighErrorRate", "warning", pd.Timestamp(at, unit="s")))
            if idle > self.idle_for:
                fired.append(("ProcessingStopped", "critical", pd.Timestamp(at, unit="s")))
        self.now.update((at, high, idle))
        reach = at + 60 - 60 * max(ERROR_WINDOW, self.idle_minutes)
        for minute in counts:
            if minute < reach and self.minutes.containsKey((minute,)):
                self.minutes.removeKey((minute,))
        # one timer at a time: the next evaluation, should no row come
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((at + 60) * 1000)
        return pd.DataFrame(fired, columns=["alert", "severity", "fired_at"])

    def _known(self) -> dict[int, tuple[int, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.minutes.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = {int(m): (int(p), int(e)) for part in rows for m, p, e in zip(part["minute"], part["processed"], part["errors"])}
        real = [m for m, (p, e) in came.items() if p or e]
        if not self.now.exists():
            if not real:
                return
            self.now.update((min(real), 0, 0))  # the first evaluation is at the end of the first minute with events
        for m, counts in came.items():
            self.minutes.updateValue((m,), counts)
        yield self._advance(max(came) + 60, self._known())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // 60_000 * 60
        yield self._advance(max(upto, expiredTimerInfo.getExpiryTimeInMs() // 1000), self._known())


def alert_stream(
    events: DataFrame, ticks: DataFrame | None = None, ts: str = "ts", failed: str = "failed", delay: str = "1 minute",
    max_error_rate: float = 0.1, error_minutes: int = 2, idle_minutes: int = 10, idle_for: int = 10,
) -> DataFrame:
    """(alert, severity, fired_at) as soon as a minute at which an alert fires is closed, each once; the same as ``metrics.alerts`` finds
    between the first and the last event, and ProcessingStopped goes on after that.

    Time goes on with the watermark, ``delay`` behind the events; events that come later are left out. Where events may stay away
    altogether, ``ticks`` (a stream with a timestamp ``ts``, such as the rate source) keeps time. Only one row a minute reaches the state
    that follows the minutes. Start the query in ``state_on_disk`` with output mode append.
    """
    rows = events.select(F.col(ts).alias("ts"), F.col(failed).alias("failed"))
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.col(ts).alias("ts"), F.lit(None).cast("boolean").alias("failed")))
    counts = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute")).agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if(F.col("failed")).alias("errors"))
    minutes = counts.select(F.lit(1).alias("key"), F.window_time("window").alias("closed"), F.unix_timestamp("window.start").alias("minute"), "processed", "errors")
    watch = Watch(max_error_rate, error_minutes, idle_minutes, idle_for)
    return minutes.groupBy("key").transformWithStateInPandas(watch, ALERT, "append", "eventTime")
