"""Feature assembly, encodings and scaling fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS
from pingloom.functions.scalars import RUSH_HOURS, clip
from pingloom.functions.times import local_hour, minutes_since_midnight, weekday
from pingloom.operators import events, history, timepoints, windows
from pingloom.operators.joins import join_weather_hour
from pingloom.plans.stages import materialize

PING_FEATURES = ["gps_speed_mps", *[f"speed_{s}_{w}s" for w in DEFAULTS.rolling_s for s in ("mean", "std")], "acceleration", "is_idle_gps", "seconds_idle"]

ROW_INPUTS = ["route_id", "pattern_id", "passenger_load"]  # inputs that a ping brings along


def _dense(domain: DataFrame, order: Sequence[str], output: str) -> DataFrame:
    """Zero-based position of each row of a domain in its order.

    Range partitions are ranked each in its own task; the one row a partition that counts the rows before it is what is
    summed in one place. The ranges are written first, as their borders are sampled anew each time they are computed.
    """
    ranged = materialize(domain.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(before, "_part").withColumn(output, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def dictionary_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Dense index by sorted order of the distinct values; NULL stays NULL."""
    domain = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(_dense(domain, [column], output), column, "left")


def first_seen_encode(df: DataFrame, column: str, order: Sequence[str], output: str) -> DataFrame:
    """Dense index by first appearance."""
    domain = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_at"))
    return df.join(_dense(domain, ["_at", column], output).drop("_at"), column, "left")


def zscore_fit(train: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column (a deviation below 1e-6 counts as 1), optionally per key."""
    stats = []
    for c in columns:
        sd = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"{c}_mean"), F.when(sd < 1e-6, F.lit(1.0)).otherwise(sd).alias(f"{c}_std")]
    return (train.groupBy(*keys) if keys else train.groupBy()).agg(*stats)


def zscore_apply(df: DataFrame, fit: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    if keys:
        joined = df.join(fit, list(keys), "left")
        scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
        return joined.select(*df.columns, *[s.alias(f"{c}_z") for c, s in scaled.items()])
    row = fit.select(F.struct(*fit.columns).alias("f")).scalar()
    return df.select("*", *[((F.col(c) - row[f"{c}_mean"]) / row[f"{c}_std"]).alias(f"{c}_z") for c in columns])


def game_day_features(df: DataFrame, games: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Game-day flag and hours to kickoff (negative after it) by the UTC day."""
    day = F.floor(F.col(ts) / 86_400_000)
    per_day = games.groupBy(F.floor(F.col("kickoff_ms") / 86_400_000).alias("_day")).agg(F.min("kickoff_ms").alias("_kick"))
    joined = df.withColumn("_day", day).join(per_day, "_day", "left")
    return joined.select(
        *df.columns, F.col("_kick").isNotNull().cast("int").alias("is_game_day"),
        F.coalesce((F.col("_kick") - F.col(ts)) / F.lit(3_600_000.0), F.lit(0.0)).alias("hours_to_kickoff"))


def base_features(df: DataFrame, stop_seq: DataFrame, weather: DataFrame, temperature_default: Column,
                  scheduled: str = "scheduled_eta_s", ts: str = "ts_ms") -> DataFrame:
    """The plain features of a ping-stop row; the row count cannot change (unique lookups)."""
    length = stop_seq.groupBy("route_id").agg(F.max("max_dist").alias("_length"))
    placed = join_weather_hour(df.join(length, "route_id", "left"), weather, ts, temperature_default)
    return placed.select(
        *df.columns,
        clip((F.col("target_stop_progress") - F.col("progress")) * F.col("_length"), low=0.0).alias("distance_to_target"),
        clip(F.col(scheduled), low=0.0).alias("scheduled_time_to_target"),
        F.col("speed").alias("current_speed"), F.col("progress").alias("route_progress"), F.col("stops_away").alias("stops_remaining"),
        F.col("target_stop_sequence").alias("stop_index"), minutes_since_midnight(ts).alias("minutes_since_midnight"),
        weekday(ts).alias("day_of_week"), "precipitation_mm", "temperature_c", (F.col("speed") <= 2).cast("int").alias("is_idle"),
    )


def ping_features(pings: DataFrame, thresholds=DEFAULTS) -> DataFrame:
    """Trajectory features on unique pings, before any fan-out to target stops."""
    marked = windows.trajectory_windows(pings, thresholds)
    return events.streak_seconds(marked, windows.TRACK, "ts_ms", ("ts_ms", "event_id"))


def history_lookups(pings: DataFrame, thresholds=DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segment, dwell and speed cells from training pings that carry the ping features."""
    cell = lambda df, ts: df.withColumn("hour_ct", local_hour(ts)).withColumn("day_type", (weekday(ts) < 5).cast("int"))
    travel = events.segment_travel(pings, max_ms=thresholds.max_gap_ms)
    dwells = events.dwell_events(pings, "gps_speed_mps", moving_from=thresholds.idle_speed_mps, max_ms=thresholds.max_gap_ms)
    return (
        history.hist_segments(cell(travel, "ts_ms"), thresholds.history_min_obs),
        history.hist_dwells(cell(dwells, "arrival_ms"), thresholds.history_min_obs),
        history.hist_speed(cell(pings, "ts_ms"), min_obs=thresholds.history_min_obs),
    )


def assemble_features(
    rows: DataFrame, pings: DataFrame, lookups: tuple[DataFrame, DataFrame, DataFrame], timetable: DataFrame, stop_seq: DataFrame,
    weather: DataFrame, temperature_default: Column, scheduled: str = "scheduled_eta_s",
) -> DataFrame:
    """All model inputs for ping-stop rows; ``pings`` carries :func:`ping_features`."""
    segments, dwells, speeds = lookups
    out = base_features(rows, stop_seq, weather, temperature_default, scheduled)
    out = timepoints.merge_back(out, pings, PING_FEATURES)
    out = out.withColumn("hour_ct", local_hour("ts_ms")).withColumn("day_type", (weekday("ts_ms") < 5).cast("int"))
    out = out.join(segments.drop("n"), ["route_id", "last_stop_id", "hour_ct", "day_type"], "left")
    here = dwells.drop("n").withColumnRenamed("stop_id", "last_stop_id")
    there = dwells.drop("n").select("route_id", F.col("stop_id").alias("target_stop_id"), "hour_ct", "day_type", *[
        F.col(f"dwell_{s}").alias(f"target_dwell_{s}") for s in ("median", "p25", "p75")])
    out = out.join(here, ["route_id", "last_stop_id", "hour_ct", "day_type"], "left")
    out = out.join(there, ["route_id", "target_stop_id", "hour_ct", "day_type"], "left")
    out = history.speed_ratio(out, speeds)
    out = timepoints.is_timepoint(out, timetable)
    departures = timepoints.scheduled_departure(timetable).withColumnRenamed("stop_id", "target_stop_id")
    out = out.join(departures, ["route_id", "target_stop_id"], "left")
    out = timepoints.timepoint_features(out, timetable, stop_seq)
    return out.withColumn("is_rush_hour", F.col("hour_ct").isin(*RUSH_HOURS).cast("int"))


def with_baselines(assembled: DataFrame, train: DataFrame, travel: DataFrame, stop_seq: DataFrame, label: str = "label_s", min_obs: int = 3) -> DataFrame:
    """The three baselines fitted on training rows, and the target: what the label is beyond the tier cascade's estimate."""
    from pingloom.plans.batch import baseline_stage

    prorated = history.prorated_baseline(assembled, history.prorated_segments(stop_seq, travel, min_obs)).withColumnRenamed("baseline_prorated", "baseline_seg_sum")
    out = baseline_stage(train, prorated, stop_seq, output="baseline_eta")
    return out.select(*assembled.columns, "baseline_s2s", "baseline_seg_sum", "baseline_eta", (F.col(label) - F.col("baseline_eta")).alias("residual"))


def model_inputs(out: DataFrame, rows: DataFrame, target: str = "residual") -> list[str]:
    """The inputs: what assembly has added to the rows, and those the rows had."""
    added = [c for c in out.columns if c not in rows.columns and c not in (target, "hour_ct", "day_type")]
    return [*[c for c in ROW_INPUTS if c in rows.columns], *added]


def check_assembly(out: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in and out; a difference fails the job."""
    before = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    wrong = F.raise_error(F.lit("assembly changed the number of rows")).cast("long")
    return out.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == before, F.col("n")).otherwise(wrong).alias("rows"))
