"""Per-vehicle windows over telemetry. Times are epoch milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS
from pingloom.functions.geo import haversine
from pingloom.functions.scalars import clip, heading_change
from pingloom.plans.slices import SLICE, bounded_lag, lag_across, reach_slice, with_halo

TRACK = ("vehicle_id", "route_id")


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; copies merge before the shuffle, so a mass of duplicates stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def lag_by(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Previous row's values within the key, over all time."""
    return lag_across(df, keys, ts, order, columns)


def gps_speed(
    df: DataFrame, keys: Sequence[str] = TRACK, ts: str = "ts_ms", order: Sequence[str] = ("ts_ms", "event_id"),
    min_delta_ms: int = DEFAULTS.min_delta_ms, max_gap_ms: int = DEFAULTS.max_gap_ms, cap: float = DEFAULTS.gps_speed_cap_mps,
) -> DataFrame:
    """Metres per second since the previous ping; NULL for jitter, gaps and the first ping."""
    prev = bounded_lag(df, keys, ts, order, {"_lat": "lat", "_lon": "lon", "_ts": ts}, max_gap_ms)
    seconds = (F.col(ts) - F.col("_ts")) / F.lit(1000.0)
    speed = F.try_divide(haversine("_lat", "_lon", "lat", "lon"), seconds)
    valid = F.col(ts) - F.col("_ts") >= min_delta_ms
    return prev.select(*df.columns, F.when(valid, clip(speed, high=cap)).alias("gps_speed_mps"))


def acceleration(
    df: DataFrame, speed: str = "gps_speed_mps", keys: Sequence[str] = TRACK, ts: str = "ts_ms",
    order: Sequence[str] = ("ts_ms", "event_id"), min_delta_ms: int = DEFAULTS.min_delta_ms, max_gap_ms: int = DEFAULTS.max_gap_ms,
) -> DataFrame:
    """Change of speed per second since the previous ping, with the same guards."""
    prev = bounded_lag(df, keys, ts, order, {"_speed": speed, "_ts": ts}, max_gap_ms)
    gap = F.col(ts) - F.col("_ts")
    change = F.try_divide(F.col(speed) - F.col("_speed"), gap / F.lit(1000.0))
    return prev.select(*df.columns, F.when(gap >= min_delta_ms, change).alias("acceleration"))


def _trailing(keys: Sequence[str], ts: str, span_ms: int, closed: bool) -> Window:
    """Frame (t - span, t], or [t - span, t] when closed on both ends."""
    return Window.partitionBy(*keys, SLICE).orderBy(ts).rangeBetween(-(span_ms if closed else span_ms - 1), 0)


def trajectory_windows(df: DataFrame, cfg=DEFAULTS, keys: Sequence[str] = TRACK, ts: str = "ts_ms", order: Sequence[str] = ("ts_ms", "event_id")) -> DataFrame:
    """GPS speed, its rolling statistics, acceleration and idle marks in one shuffle and one sort.

    The same results as the single operators one after another. Speed looks back one gap, what is
    built on it one gap or window more; a halo of that reach lets every step run in the same slices.
    """
    gap, spans = cfg.max_gap_ms, [s * 1000 for s in cfg.rolling_s]
    reach = gap + max(gap, *spans)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    copies = with_halo(df, ts, reach_slice(reach, cfg.slice_ms), before_ms=reach)
    delta = F.col(ts) - F.lag(ts).over(w)
    near = F.coalesce(delta <= gap, F.lit(False))
    usable = near & (delta >= cfg.min_delta_ms)
    metres = haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    moved = copies.select(
        "*", near.alias("_near"), usable.alias("_usable"), (delta / F.lit(1000.0)).alias("_s"),
        F.when(usable, clip(F.try_divide(metres, delta / F.lit(1000.0)), high=cfg.gps_speed_cap_mps)).alias("gps_speed_mps"),
    ).withColumn("is_idle_gps", F.coalesce(F.col("gps_speed_mps") < cfg.idle_speed_mps, F.lit(False)).cast("int"))
    outputs = []
    for seconds in cfg.rolling_s:
        frame = _trailing(keys, ts, seconds * 1000, closed=False)
        outputs += [F.avg("gps_speed_mps").over(frame).alias(f"speed_mean_{seconds}s"), F.stddev_samp("gps_speed_mps").over(frame).alias(f"speed_std_{seconds}s")]
    change = F.try_divide(F.col("gps_speed_mps") - F.lag("gps_speed_mps").over(w), F.col("_s"))
    begins = ~(F.col("_near") & (F.lag("is_idle_gps").over(w) == F.col("is_idle_gps")))
    return moved.select(
        *df.columns, "gps_speed_mps", *outputs, F.when(F.col("_usable"), change).alias("acceleration"), "is_idle_gps",
        F.coalesce(begins, F.lit(True)).alias("_begins"), "_home",
    ).where("_home").drop("_home")


def rolling_time(
    df: DataFrame, value: str, spans_s: Sequence[int] = DEFAULTS.rolling_s, keys: Sequence[str] = TRACK, ts: str = "ts_ms",
    prefix: str = "speed",
) -> DataFrame:
    """Trailing mean and sample deviation per span; all spans share one shuffle and one sort."""
    reach = max(spans_s) * 1000
    copies = with_halo(df, ts, reach_slice(reach), before_ms=reach)
    outputs = []
    for s in spans_s:
        w = _trailing(keys, ts, s * 1000, closed=False)
        outputs += [F.avg(value).over(w).alias(f"{prefix}_mean_{s}s"), F.stddev_samp(value).over(w).alias(f"{prefix}_std_{s}s")]
    return copies.select(*df.columns, "_home", *outputs).where("_home").drop("_home")


def rolling_stats(
    df: DataFrame, spans_s: Sequence[int] = (30, 60, 90, 120, 180, 300), keys: Sequence[str] = ("vehicle_id",), ts: str = "ts_ms",
    order: Sequence[str] = ("ts_ms", "event_id"), speed: str = "speed",
) -> DataFrame:
    """Trailing speed statistics, distance, heading change and acceleration against the window's start."""
    steps = lag_across(df, keys, ts, order, {"_lat": "lat", "_lon": "lon", "_heading": "heading"}).select(
        *df.columns,
        F.coalesce(haversine("_lat", "_lon", "lat", "lon"), F.lit(0.0)).alias("_step"),
        F.coalesce(heading_change("_heading", "heading"), F.lit(0.0)).alias("_turn"),
    )
    reach = max(spans_s) * 1000
    copies = with_halo(steps, ts, reach_slice(reach), before_ms=reach)
    outputs: list[Column] = []
    for s in spans_s:
        w = _trailing(keys, ts, s * 1000, closed=False)
        outputs += [
            F.avg(speed).over(w).alias(f"speed_avg_{s}s"),
            F.coalesce(F.stddev_samp(speed).over(w), F.lit(0.0)).alias(f"speed_std_{s}s"),
            F.max(speed).over(w).alias(f"speed_max_{s}s"),
            F.min(speed).over(w).alias(f"speed_min_{s}s"),
            ((F.col(speed) - F.first(speed).over(w)) / F.lit(float(s))).alias(f"acceleration_{s}s"),
            F.sum("_step").over(w).alias(f"distance_traveled_{s}s"),
            F.sum("_turn").over(w).alias(f"heading_change_{s}s"),
        ]
    return copies.select(*df.columns, "_home", *outputs).where("_home").drop("_home")


def history_window(
    df: DataFrame, span_ms: int = 90_000, compare_ms: int = 30_000, keys: Sequence[str] = ("vehicle_id",), ts: str = "ts_ms",
    speed: str = "speed", progress: str = "progress", min_delta_ms: int = DEFAULTS.min_delta_ms, stopped: float = 1.0,
) -> DataFrame:
    """Rolling features of the closed trailing window; zeros while it holds fewer than two rows."""
    copies = with_halo(df, ts, reach_slice(span_ms), before_ms=span_ms)
    w = _trailing(keys, ts, span_ms, closed=True)
    # the observation closest to compare_ms ago is the last one at or before it or the first one after it
    frame = Window.partitionBy(*keys, SLICE).orderBy(ts)
    spot = F.struct(F.col(ts).alias("t"), F.col(speed).alias("v"))
    older = F.last(spot).over(frame.rangeBetween(-span_ms, -compare_ms))
    newer = F.first(spot).over(frame.rangeBetween(-compare_ms, 0))
    columns = copies.select(
        *df.columns, "_home",
        F.count(F.lit(1)).over(w).alias("_n"), F.first(ts).over(w).alias("_t0"), F.first(progress).over(w).alias("_p0"),
        F.avg(speed).over(w).alias("_mean"), F.min(speed).over(w).alias("_min"), F.max(speed).over(w).alias("_max"),
        F.avg((F.col(speed) < stopped).cast("int")).over(w).alias("_still"), older.alias("_older"), newer.alias("_newer"),
    ).where("_home")
    elapsed = (F.col(ts) - F.col("_t0")) / F.lit(1000.0)
    target = F.col(ts) - F.lit(compare_ms)
    take_older = F.col("_older").isNotNull() & (
        F.col("_newer").isNull() | (target - F.col("_older.t") <= F.col("_newer.t") - target)
    )
    ref = F.when(take_older, F.col("_older")).otherwise(F.col("_newer"))
    enough = F.col("_n") >= 2
    zero = F.lit(0.0)
    return columns.select(
        *df.columns,
        F.when(enough & (elapsed > 0), (F.col(progress) - F.col("_p0")) / F.nullif(elapsed, zero)).otherwise(zero).alias("progress_rate"),
        F.when(enough, F.col("_mean")).otherwise(zero).alias("speed_rolling_mean"),
        F.when(enough, F.col("_min")).otherwise(zero).alias("speed_rolling_min"),
        F.when(enough, F.col("_max")).otherwise(zero).alias("speed_rolling_max"),
        F.when(enough & (F.col(ts) - ref["t"] > min_delta_ms), F.col(speed) - ref["v"]).otherwise(zero).alias("acceleration"),
        F.when(enough, F.col("_still") * elapsed).otherwise(zero).alias("time_stopped"),
        F.when(enough & (F.col(speed) < stopped), F.lit(1.0)).otherwise(zero).alias("is_stopped"),
    )


def every_nth(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every nth row of each (bounded) sequence, starting with its first."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where((F.col("_at") - 1) % n == 0).drop("_at")


def travel_between_stops(
    arrivals: DataFrame, keys: Sequence[str] = ("vehicle_id",), ts: str = "arrival_ms", order: Sequence[str] = ("arrival_ms", "event_id"),
    stop: str = "station", departure: str = "departure_ms",
) -> DataFrame:
    """Previous station and departure of the vehicle, and the travel time since then."""
    prev = lag_across(arrivals, keys, ts, order, {"prev_station": stop, "prev_departure_ms": departure})
    return prev.withColumn("travel_s", (F.col(ts) - F.col("prev_departure_ms")) / F.lit(1000.0))


def eta_jump_flag(
    df: DataFrame, eta_minutes: str = "eta_minutes", stop: str = "next_stop_id", keys: Sequence[str] = ("vehicle_id",),
    ts: str = "ts_ms", order: Sequence[str] = ("ts_ms", "event_id"), slack_s: float = 120.0,
) -> DataFrame:
    """1 where the ETA for the same stop moved by more than the elapsed time plus the slack."""
    prev = lag_across(df, keys, ts, order, {"_eta": eta_minutes, "_stop": stop, "_ts": ts})
    change = F.abs(F.col(eta_minutes) - F.col("_eta")) * 60
    elapsed = (F.col(ts) - F.col("_ts")) / F.lit(1000.0)
    jump = (F.col("_stop") == F.col(stop)) & (change > elapsed + slack_s)
    return prev.select(*df.columns, F.coalesce(jump, F.lit(False)).cast("int").alias("eta_jump"))
