"""Timetable features. A route's timepoints are one sorted array (bounded by its stops), joined by route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingloom.functions.times import local_ms, seconds_since_midnight
from pingloom.operators.joins import lookup_left
from pingloom.operators.quantiles import grouped_quantiles


def scheduled_departure(timepoints: DataFrame) -> DataFrame:
    """Median scheduled second per (route, stop)."""
    return grouped_quantiles(timepoints, ["route_id", "stop_id"], "scheduled_s", {"scheduled_departure_seconds": 0.5})


def timepoint_line(timepoints: DataFrame, stop_seq: DataFrame) -> DataFrame:
    """Per route its timepoints as (sequence, median scheduled second) in order."""
    placed = scheduled_departure(timepoints).join(stop_seq.select("route_id", "stop_id", "stop_sequence"), ["route_id", "stop_id"])
    return placed.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("stop_sequence", "scheduled_departure_seconds"))).alias("_tp")
    )


def is_timepoint(df: DataFrame, timepoints: DataFrame) -> DataFrame:
    """1 when the target stop is a timepoint of the route, 0 if not, NULL on routes without a timetable."""
    stops = timepoints.select("route_id", F.col("stop_id").alias("target_stop_id")).distinct().withColumn("_is", F.lit(1))
    routes = timepoints.select("route_id").distinct().withColumn("_has", F.lit(1))
    joined = df.join(stops, ["route_id", "target_stop_id"], "left").join(routes, "route_id", "left")
    return joined.select(*df.columns, F.when(F.col("_has") == 1, F.coalesce("_is", F.lit(0))).alias("is_timepoint"))


def timepoint_features(df: DataFrame, timepoints: DataFrame, stop_seq: DataFrame, offset_h: int = -6) -> DataFrame:
    """Timepoints still ahead of the target, seconds to the next one's departure, seconds past the last one's."""
    last = stop_seq.select("route_id", F.col("stop_id").alias("last_stop_id"), F.col("stop_sequence").alias("_last_seq"))
    joined = lookup_left(df, last, ["route_id", "last_stop_id"]).join(timepoint_line(timepoints, stop_seq), "route_id", "left")
    here = F.col("_last_seq")
    known = F.col("_tp").isNotNull() & here.isNotNull()
    after = F.filter("_tp", lambda t: t["stop_sequence"] > here)
    until = F.filter("_tp", lambda t: t["stop_sequence"] <= here)
    now = seconds_since_midnight(local_ms("ts_ms", offset_h))
    to_target = F.size(F.filter(after, lambda t: t["stop_sequence"] <= F.col("target_stop_sequence")))
    return joined.select(
        *df.columns,
        F.when(F.col("_tp").isNotNull(), F.when(here.isNotNull(), to_target).otherwise(F.lit(0))).cast("long").alias("timepoints_remaining"),
        F.when(known, F.get(after, F.lit(0))["scheduled_departure_seconds"] - now).alias("time_until_next_timepoint_departure"),
        F.when(known, now - F.try_element_at(until, F.lit(-1))["scheduled_departure_seconds"]).alias("timepoint_adherence"),
    )


def merge_back(exploded: DataFrame, pings: DataFrame, columns: list[str], keys: tuple[str, ...] = ("vehicle_id", "ts_ms")) -> DataFrame:
    """Window results of unique pings back on every exploded row of the ping; a doubled ping fails the job."""
    return lookup_left(exploded, pings.select(*keys, *columns), list(keys))
