"""Per-vehicle state for Structured Streaming. Spark keys, partitions and checkpoints it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY_SCHEMA = """
    vehicle_id BIGINT, event_id BIGINT, ts_ms BIGINT, progress_rate DOUBLE, speed_rolling_mean DOUBLE, speed_rolling_min DOUBLE,
    speed_rolling_max DOUBLE, acceleration DOUBLE, time_stopped DOUBLE, is_stopped DOUBLE"""
SILENCE_SCHEMA = "vehicle_id BIGINT, last_ms BIGINT, silent_ms BIGINT"
SMOOTH_SCHEMA = "vehicle_id BIGINT, event_id BIGINT, ts_ms BIGINT, eta_s DOUBLE, smoothed_s DOUBLE"


SHORT = 64  # rows a window has on average, up to which windows are folded one by one


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A vehicle's rows of one trigger; how many those can be is bounded by the files a trigger takes."""
    rows = list(batches)
    new = rows[0] if len(rows) == 1 else pd.concat(rows)
    return new.iloc[np.lexsort((new["event_id"].to_numpy(), new["ts_ms"].to_numpy()))].reset_index(drop=True)


class _Since(BaseIndexer):
    """Windows from given first rows up to each row."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first, np.arange(1, num_values + 1)


class HistoryProcessor(StatefulProcessor):
    """Keeps the closed trailing window of (time, speed, progress) and emits its features per packet.

    The time span alone bounds what is kept. State a vehicle doesn't touch for ``ttl_ms`` (if given) expires.
    """

    def __init__(self, span_ms: int, compare_ms: int, ttl_ms: int | None) -> None:
        self.span_ms, self.compare_ms, self.ttl_ms = span_ms, compare_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("window", "ts_ms BIGINT, speed DOUBLE, progress DOUBLE", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = list(self.buffer.get())
        new = _in_order(rows)
        kinds = {"ts_ms": "int64", "speed": "float64", "progress": "float64"}
        t, v, p = (np.concatenate([np.array([r[i] for r in old], dtype=float if k == "float64" else k), new[c].to_numpy().astype(k)]) for i, (c, k) in enumerate(kinds.items()))
        first = np.searchsorted(t, t - self.span_ms, "left")
        out = self._features(t, v, p, first)
        if len(t):
            kept = slice(first[-1], None)
            self.buffer.put(list(zip(t[kept].tolist(), v[kept].tolist(), p[kept].tolist(), strict=True)))
        yield pd.DataFrame({"vehicle_id": key[0], "event_id": new["event_id"], "ts_ms": new["ts_ms"], **{c: x[len(old):] for c, x in out.items()}})

    def _features(self, t: np.ndarray, v: np.ndarray, p: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        here = np.arange(len(t))
        enough = here - first >= 1
        since = _Since()
        since.first = first
        # windows of a few rows are folded one by one: setting up a rolling window takes longer than they do
        short = (here - first).sum() < SHORT * len(t) and not np.isnan(v).any()
        ends = np.column_stack([first, here + 1]).ravel()

        def window(x: np.ndarray, how: str) -> np.ndarray:
            if not short:
                return getattr(pd.Series(x).rolling(since, min_periods=1), how)().to_numpy()
            fold = {"mean": np.add, "min": np.minimum, "max": np.maximum}[how]
            folded = fold.reduceat(np.append(x, 0.0), ends)[::2]
            return folded / (here - first + 1) if how == "mean" else folded

        elapsed = (t - t[first]) / 1000.0
        # the row nearest to compare_ms ago, the earliest of those equally near
        target = t - self.compare_ms
        after = np.clip(np.searchsorted(t, target, "left"), first, here)
        before = np.maximum(after - 1, first)
        ref = np.where(np.abs(t[before] - target) <= np.abs(t[after] - target), before, after)
        ref = np.maximum(np.searchsorted(t, t[ref], "left"), first)
        still = (v < 1.0).astype(float)
        zero = lambda x: np.where(enough, x, 0.0)
        return {
            "progress_rate": zero(np.where(elapsed > 0, (p - p[first]) / np.where(elapsed > 0, elapsed, 1.0), 0.0)),
            "speed_rolling_mean": zero(window(v, "mean")), "speed_rolling_min": zero(window(v, "min")), "speed_rolling_max": zero(window(v, "max")),
            "acceleration": zero(np.where(t - t[ref] > 5000, v - v[ref], 0.0)), "time_stopped": zero(window(still, "mean") * elapsed), "is_stopped": zero(still),
        }

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Smoothing:
    """One step of the smoothed ETA; a state is (route_id, trip_id, progress, smoothed)."""

    alpha: float
    bypass_s: float
    max_rise_s: float

    def step(self, state: tuple | None, route, trip, progress: float, eta: float) -> tuple:
        run = (None if route is None or route != route else int(route), None if trip is None else str(trip))
        eta, value = float(eta), float(eta)
        if state is not None and state[:2] == run:
            previous = state[3]
            if not abs(eta - previous) > self.bypass_s:
                value = self.alpha * eta + (1 - self.alpha) * previous
            if progress > state[2] and value > previous + self.max_rise_s:
                value = previous + self.max_rise_s
        return (*run, float(progress), value)


class SmoothProcessor(StatefulProcessor):
    """Moving average of a vehicle's ETA with bypass, monotone guard and reset on a change of route or trip; idle state expires."""

    def __init__(self, smoothing: Smoothing, ttl_ms: int | None) -> None:
        self.smoothing, self.ttl_ms = smoothing, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "route_id BIGINT, trip_id STRING, progress DOUBLE, smoothed DOUBLE", ttlDurationMs=self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.last.update((int(row["route_id"]), None if pd.isna(row["trip_id"]) else str(row["trip_id"]), float(row["progress"]), float(row["smoothed"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in _in_order(rows).itertuples():
            state = self.smoothing.step(state, r.route_id, r.trip_id, r.progress, r.eta_s)
            out.append((key[0], r.event_id, r.ts_ms, float(r.eta_s), state[3]))
        if state is not None:
            self.last.update(state)
        yield pd.DataFrame(out, columns=["vehicle_id", "event_id", "ts_ms", "eta_s", "smoothed_s"])

    def close(self) -> None:
        pass


class SilenceProcessor(StatefulProcessor):
    """Tells when a vehicle has sent nothing for ``idle_ms`` of event time; its state is dropped then."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms BIGINT")

    def _told(self, key, times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"vehicle_id": [key[0]] * len(times), "last_ms": times, "silent_ms": [t + self.idle_ms for t in times]}).astype("int64")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted({int(t) for batch in rows for t in batch["ts_ms"]})
        old = int(self.last.get()[0]) if self.last.exists() else None
        if old is not None:
            self.handle.deleteTimer(old + self.idle_ms)
            times = [old, *(t for t in times if t > old)]
        self.last.update((times[-1],))
        self.handle.registerTimer(times[-1] + self.idle_ms)
        # silences that began and ended within the rows of a trigger
        yield self._told(key, [a for a, b in zip(times, times[1:], strict=False) if b - a > self.idle_ms])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        yield self._told(key, [last])

    def close(self) -> None:
        pass
