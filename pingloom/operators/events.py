"""Trajectory events: transitions, idle streaks, dwells, approaches, detected arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS
from pingloom.functions.times import floor_div
from pingloom.operators.joins import asof_next, match_event_window
from pingloom.plans.slices import bounded_lag, fill_across, lag_across

TRACK = ("vehicle_id", "route_id")
ORDER = ("ts_ms", "event_id")


def with_change(df: DataFrame, column: str, keys: Sequence[str] = TRACK, ts: str = "ts_ms", order: Sequence[str] = ORDER) -> DataFrame:
    """Adds the previous value and whether a non-NULL previous value differs from this one."""
    prev = lag_across(df, keys, ts, order, {"prev_value": column, "prev_ts_ms": ts})
    return prev.withColumn("changed", F.coalesce(F.col("prev_value") != F.col(column), F.lit(False)))


def stop_transitions(df: DataFrame, column: str = "last_stop_id", keys: Sequence[str] = TRACK) -> DataFrame:
    return with_change(df, column, keys).where("changed").drop("changed")


def idle_streaks(
    df: DataFrame, speed: str, keys: Sequence[str] = TRACK, ts: str = "ts_ms", order: Sequence[str] = ORDER,
    idle_below: float = DEFAULTS.idle_speed_mps, max_gap_ms: int = DEFAULTS.max_gap_ms,
) -> DataFrame:
    """Idle flag and seconds since the idle streak began; a state change or a gap begins a streak."""
    flagged = df.withColumn("is_idle_gps", F.coalesce(F.col(speed) < idle_below, F.lit(False)).cast("int"))
    # a longer gap begins a streak anyway, so the look-back is bounded by it
    prev = bounded_lag(flagged, keys, ts, order, {"_idle": "is_idle_gps"}, max_gap_ms)
    begins = ~F.col("_idle").eqNullSafe(F.col("is_idle_gps"))
    return streak_seconds(prev.withColumn("_begins", begins), keys, ts, order).select(*df.columns, "is_idle_gps", "seconds_idle")


def streak_seconds(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str]) -> DataFrame:
    """Seconds since the running idle streak began, from ``is_idle_gps`` and ``_begins``."""
    runs = fill_across(df, keys, ts, order, {"_from": F.when(F.col("_begins"), F.col(ts))})
    seconds = F.when(F.col("is_idle_gps") == 1, (F.col(ts) - F.col("_from")) / F.lit(1000.0)).otherwise(F.lit(0.0))
    return runs.withColumn("seconds_idle", seconds).drop("_from", "_begins")


def segment_travel(df: DataFrame, column: str = "last_stop_id", keys: Sequence[str] = TRACK, max_ms: int = DEFAULTS.max_gap_ms) -> DataFrame:
    """Time between successive transitions where it lies in (0, max]."""
    marks = stop_transitions(df, column, keys).drop("prev_value", "prev_ts_ms")
    prev = lag_across(marks, keys, "ts_ms", ORDER, {"prev_transition_ms": "ts_ms"})
    gap = F.col("ts_ms") - F.col("prev_transition_ms")
    return prev.where((gap > 0) & (gap <= max_ms)).withColumn("segment_s", gap / F.lit(1000.0))


def dwell_events(
    df: DataFrame, speed: str, column: str = "last_stop_id", keys: Sequence[str] = TRACK,
    moving_from: float = DEFAULTS.idle_speed_mps, max_ms: int = DEFAULTS.max_gap_ms,
) -> DataFrame:
    """Per arrival: from the transition to the first moving ping, else to the last ping before the next one."""
    marked = with_change(df, column, keys)
    grouped = fill_across(marked, keys, "ts_ms", ORDER, {"arrival_ms": F.when(F.col("changed"), F.col("ts_ms")),
                                                        "stop_id": F.when(F.col("changed"), F.col(column))})
    moving = F.coalesce(F.col(speed) >= moving_from, F.lit(False))
    ends = grouped.where("arrival_ms IS NOT NULL").groupBy(*keys, "arrival_ms", "stop_id").agg(
        F.min(F.when(moving, F.col("ts_ms"))).alias("_leave"), F.max("ts_ms").alias("_last")
    )
    dwell = F.coalesce("_leave", "_last") - F.col("arrival_ms")
    return ends.where((dwell > 0) & (dwell <= max_ms)).select(
        *keys, "stop_id", "arrival_ms", (dwell / F.lit(1000.0)).alias("dwell_s")
    )


def detect_arrivals(df: DataFrame, keys: Sequence[str] = ("vehicle_id",)) -> DataFrame:
    """A new non-zero last stop is an arrival at it, at the feed's stop time or the ping's own."""
    prev = lag_across(df, keys, "ts_ms", ORDER, {"_stop": "last_stop_id"})
    here = F.nullif("last_stop_id", F.lit(0))
    is_new = here.isNotNull() & ~here.eqNullSafe(F.nullif("_stop", F.lit(0)))
    return prev.where(is_new).select(
        *keys, "event_id", "ts_ms", F.col("last_stop_id").alias("stop_id"), F.coalesce("last_stop_time_ms", "ts_ms").alias("arrival_ms")
    )


def approach_sequences(df: DataFrame, column: str = "next_stop_id", keys: Sequence[str] = ("vehicle_id",), min_length: int = 3) -> DataFrame:
    """Maximal runs of pings with one next stop: start, end, length."""
    runs = _runs(df, column, keys)
    return runs.groupBy(*keys, F.col(column).alias("stop_id"), "run_start_ms").agg(
        F.max("ts_ms").alias("run_end_ms"), F.count(F.lit(1)).alias("n_pings")
    ).where(F.col("n_pings") >= min_length)


def _runs(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Every ping with the start time of its run of equal values."""
    prev = lag_across(df, keys, "ts_ms", ORDER, {"_prev": column, "_any": "ts_ms"})
    begins = F.col("_any").isNull() | ~F.col("_prev").eqNullSafe(F.col(column))
    return fill_across(prev, keys, "ts_ms", ORDER, {"run_start_ms": F.when(begins, F.col("ts_ms"))}).drop("_prev", "_any")


def label_by_transition(
    df: DataFrame, arrivals: DataFrame, keys: Sequence[str] = ("vehicle_id",), before_ms: int = DEFAULTS.window_before_ms,
    after_ms: int = DEFAULTS.window_after_ms, low_s: float = 30.0, high_s: float = 900.0,
) -> DataFrame:
    """Every ping of an approach labelled with the arrival matched at the approach's end.

    The end of a run is the time of the first ping with another next stop; the arrival is the
    first one inside the window round it. Labels outside (low, high) seconds are dropped.
    """
    stop = "next_stop_id"
    runs = _runs(df, stop, keys)
    per_run = runs.groupBy(*keys, F.col(stop).alias("stop_id"), "run_start_ms").agg(F.max("ts_ms").alias("_last"))
    # the next run's start is the transition; runs are few per vehicle and lie in time order
    ended = lag_across(
        per_run.withColumn("_neg", -F.col("run_start_ms")), keys, "_neg", ("_neg",), {"transition_ms": "run_start_ms"}
    ).where("transition_ms IS NOT NULL AND stop_id <> 0")
    matched = match_event_window(
        ended, arrivals, [*keys, "stop_id"], "transition_ms", "arrival_ms", before_ms, after_ms, nearest=False
    ).where("matched_ms IS NOT NULL").select(*keys, "run_start_ms", "matched_ms")
    eta = (F.col("matched_ms") - F.col("ts_ms")) / F.lit(1000.0)
    return runs.join(matched, [*keys, "run_start_ms"]).withColumn("label_s", eta).where(
        (F.col("label_s") > low_s) & (F.col("label_s") < high_s)
    )


def label_by_lookback(df: DataFrame, keys: Sequence[str] = ("vehicle_id",), max_ms: int = 3_600_000) -> DataFrame:
    """A detected arrival at a stop labels every earlier ping heading there, up to ``max_ms`` before.

    Interval join on time buckets of the reach: each arrival serves its own bucket and the one before.
    """
    arrivals = detect_arrivals_after_first(df, keys)
    asked = df.where("next_stop_id <> 0").select(*keys, "event_id", F.col("next_stop_id").alias("stop_id"), F.col("ts_ms"), floor_div("ts_ms", max_ms).alias("_b"))
    served = arrivals.select(*keys, "stop_id", "arrival_ms", F.col("ts_ms").alias("_seen_ms"), F.col("event_id").alias("_seen_id"), F.explode(
        F.sequence(floor_div(F.col("arrival_ms") - max_ms, max_ms), floor_div("arrival_ms", max_ms))).alias("_b"))
    earlier = (F.col("ts_ms") < F.col("_seen_ms")) | ((F.col("ts_ms") == F.col("_seen_ms")) & (F.col("event_id") < F.col("_seen_id")))
    gap = F.col("arrival_ms") - F.col("ts_ms")
    return asked.join(served, [*keys, "stop_id", "_b"]).where(earlier & gap.between(0, max_ms)).select(
        *keys, "event_id", "stop_id", "ts_ms", "arrival_ms", (gap / F.lit(1000.0)).alias("label_s")
    )


def detect_arrivals_after_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrivals as in :func:`detect_arrivals`, but a vehicle's very first stop is not an arrival."""
    prev = lag_across(df, keys, "ts_ms", ORDER, {"_stop": "last_stop_id"})
    here, before = F.nullif("last_stop_id", F.lit(0)), F.nullif("_stop", F.lit(0))
    return prev.where(here.isNotNull() & before.isNotNull() & (here != before)).select(
        *keys, "event_id", "ts_ms", F.col("last_stop_id").alias("stop_id"), F.coalesce("last_stop_time_ms", "ts_ms").alias("arrival_ms")
    )


def downsample_last(df: DataFrame, keys: Sequence[str] = TRACK, ts: str = "ts_ms", bucket_ms: int = 60_000, order: Sequence[str] = ORDER) -> DataFrame:
    """Last non-NULL value of every column per key and time bucket."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest]
    return df.groupBy(*keys, (floor_div(ts, bucket_ms) * bucket_ms).alias("bucket_ms")).agg(*last)


def transition_timing(df: DataFrame, arrivals: DataFrame, keys: Sequence[str] = ("vehicle_id",), reach_ms: int = 86_400_000, near_s: float = 30.0) -> DataFrame:
    """How far the feed's stop change lies from the true arrival that follows the last ping before it."""
    marks = stop_transitions(df, "next_stop_id", keys).where("prev_value <> 0").select(
        *keys, F.col("prev_value").alias("stop_id"), "ts_ms", "prev_ts_ms"
    )
    matched = asof_next(marks, arrivals, [*keys, "stop_id"], "prev_ts_ms", "arrival_ms", reach_ms, "true_ms", strict=True)
    diff = matched.where("true_ms IS NOT NULL").select(((F.col("ts_ms") - F.col("true_ms")) / F.lit(1000.0)).alias("diff_s"))
    return diff.agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff_s").alias("mean_s"), F.stddev_pop("diff_s").alias("std_s"),
        F.min("diff_s").alias("min_s"), F.max("diff_s").alias("max_s"),
        F.count_if(F.col("diff_s") < -near_s).alias("n_early"), F.count_if(F.col("diff_s") > near_s).alias("n_late"),
        F.count_if(F.col("diff_s").between(-near_s, near_s)).alias("n_on_time"),
    )
