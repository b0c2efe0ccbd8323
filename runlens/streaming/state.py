"""Stateful streams: liveness by silence, and smoothers that carry their moments from batch to batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.points import SERIES

SILENT_MS, DEAD_MS = 10_000, 600_000
_FOLDS = 500.0


def liveness(points: DataFrame, watermark: str = "5 seconds") -> DataFrame:
    """Status changes of runs (run_id, at_ms, status) in event time: running at a point, unresponsive after ten seconds of
    silence, presumed dead after ten minutes. ``points``: run_id, event_time. One small state for each run."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status = state.get if state.exists else (0, "")
        out: list[tuple[str, int, str]] = []
        if state.hasTimedOut:
            status, at = ("unresponsive", last + SILENT_MS) if status == "running" else ("presumed dead", last + DEAD_MS)
            out.append((key[0], at, status))
        else:
            times = np.sort(np.concatenate([pd.to_datetime(r["event_time"]).astype("datetime64[ms]").astype("int64").to_numpy() for r in rows]))
            times = times[times >= last]
            if len(times):
                before = np.concatenate([[last], times[:-1]])
                quiet = times - before
                was = np.full(len(times), "running", object)
                was[0] = status
                # what happened before each point: silence, death, and the point that ends either
                silent, dead = (was == "running") & (quiet >= SILENT_MS), (was != "") & (was != "presumed dead") & (quiet >= DEAD_MS)
                back = (was != "running") | silent
                events = [(before[silent] + SILENT_MS, "unresponsive"), (before[dead] + DEAD_MS, "presumed dead"), (times[back], "running")]
                found = sorted((int(t), k, name) for k, (at, name) in enumerate(events) for t in at)
                out += [(key[0], t, name) for t, _, name in found]
                last, status = int(times[-1]), "running"
        state.update((last, status))
        wait = SILENT_MS if status == "running" else DEAD_MS
        if status != "presumed dead":
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "at_ms", "status"])

    return (
        points.select("run_id", "event_time")
        .withWatermark("event_time", watermark)
        .groupBy("run_id")
        .applyInPandasWithState(step, "run_id string, at_ms long, status string", "last long, status string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def ema(points: DataFrame, tau: float) -> DataFrame:
    """An order-0 EMA of each series (project_id, run_id, metric_name, tag) that goes on from the state of the batches before:
    moments decay by exp(-dx / tau). ``points``: the series' columns, step, value; a batch's rows are taken in step order, rows
    at or before the last step are left to recomputation."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, w, s = state.get if state.exists else (-math.inf, 0.0, 0.0)
        pdf = pd.concat(list(rows)).sort_values("step")
        pdf = pdf[np.isfinite(pdf["value"]) & (pdf["step"] > last)].drop_duplicates("step", keep="last")
        x, y = pdf["step"].to_numpy(np.float64), pdf["value"].to_numpy(np.float64)
        values = []
        while len(x):
            # weights relative to the stretch's start; _FOLDS time constants stay far from overflow
            n = max(1, int(np.searchsorted(x, x[0] + _FOLDS * tau)))
            grow = np.exp((x[:n] - x[0]) / tau)
            carry = math.exp(-(x[0] - last) / tau) if w else 0.0
            ws, ss = w * carry + np.cumsum(grow), s * carry + np.cumsum(grow * y[:n])
            values.append(ss / ws)
            last, w, s = float(x[n - 1]), float(ws[-1] / grow[-1]), float(ss[-1] / grow[-1])
            x, y = x[n:], y[n:]
        state.update((float(last), w, s))
        yield pd.DataFrame(dict(zip(SERIES, key, strict=True)) | {"step": pdf["step"].to_numpy(), "smoothed": np.concatenate(values) if values else np.empty(0)})

    return points.groupBy(*SERIES).applyInPandasWithState(
        step, "project_id string, run_id string, metric_name string, tag string, step long, smoothed double", "last double, w double, s double", "append", GroupStateTimeout.NoTimeout
    )
