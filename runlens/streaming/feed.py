"""The change feed as a stateful stream: listeners get a run's newest version, at most one frame in each interval.

State of a run is what was sent last and what waits; a timer sends what waits when the interval is over, another forgets a run
that has been silent for long. Versions only grow, so a replayed or late micro-batch sends nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVERY_MS, FORGET_MS = 1000, 3_600_000
_OUT = "run_id string, version long, at_ms long"


class _Frames(StatefulProcessor):
    def __init__(self, every_ms: int, forget_ms: int, events: bool):
        self.every, self.forget, self.events = every_ms, forget_ms, events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "sent long, sent_at long, waiting long, seen_at long")

    def _frame(self, key: tuple, version: int, at: int) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "version": [version], "at_ms": [at]})

    def _keep(self, sent: int, sent_at: int, waiting: int, seen_at: int) -> None:
        self.state.update((sent, sent_at, waiting, seen_at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(sent_at + self.every if waiting > sent else seen_at + self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sent, sent_at, waiting, seen_at = self.state.get() if self.state.exists() else (-1, -(1 << 60), -1, -(1 << 60))
        before, out = sent, []
        clock = timerValues.getCurrentProcessingTimeInMs()
        # a block of rows at a time, by the moment each counts at
        for block in rows:
            moments = block.groupby("at_ms", sort=True)["version"].max().items() if self.events else [(clock, block["version"].max())]
            for at, version in moments:
                at, version = int(at), int(version)
                if waiting > sent and at > sent_at + self.every:
                    # what waited was due before this moment
                    sent, sent_at = waiting, sent_at + self.every
                    out.append((sent, sent_at))
                seen_at = max(seen_at, at)
                if version <= sent:
                    continue
                if at >= sent_at + self.every:
                    sent, sent_at = max(version, waiting), at
                    out.append((sent, sent_at))
                waiting = max(waiting, version)
        self._keep(sent, sent_at, waiting, max(seen_at, sent_at))
        assert sent >= before
        for version, at in out:
            yield self._frame(key, version, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        sent, sent_at, waiting, seen_at = self.state.get()
        if waiting > sent:
            at = int(expiredTimerInfo.getExpiryTimeInMs())
            self._keep(waiting, at, waiting, seen_at)
            yield self._frame(key, waiting, at)
        else:
            self.state.clear()  # a run that has been silent that long


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors keep state and timers in RocksDB; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def frames(changes: DataFrame, every_ms: int = EVERY_MS, forget_ms: int = FORGET_MS, watermark: str | None = None) -> DataFrame:
    """Frames (run_id, version, at_ms) of a stream of changes (run_id, version).

    By the wall clock: a change is sent at once if the run's last frame is an interval ago, else when that is over. With
    ``watermark`` by the changes' own time ``event_time``, for replays of the past: the same frames whatever the batches."""
    use_state_store(changes.sparkSession)
    events = watermark is not None
    rows = changes.withWatermark("event_time", watermark).select("run_id", "version", F.unix_millis("event_time").alias("at_ms"), "event_time") if events else changes.select("run_id", "version", F.lit(0).cast("long").alias("at_ms"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Frames(every_ms, forget_ms, events), _OUT, "Append", "EventTime" if events else "ProcessingTime")
