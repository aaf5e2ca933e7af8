"""Route network tables: canonical shapes, stop sequences, indexes of stops and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingloom.plans.stages import materialize


def stop_times_with_trip(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop times with route and shape of their trip; trips counted once each."""
    unique = trips.groupBy("trip_id").agg(F.min_by(F.struct("route_id", "shape_id"), F.struct("route_id", "shape_id")).alias("_t"))
    return stop_times.join(unique, "trip_id", "left").select(
        *stop_times.columns, F.col("_t.route_id").alias("route_id"), F.col("_t.shape_id").alias("shape_id")
    )


def canonical_shape(stop_times: DataFrame) -> DataFrame:
    """Per route the shape with most distinct trips, smallest shape id on a tie."""
    used = stop_times.groupBy("route_id", "shape_id").agg(F.count_distinct("trip_id").alias("_trips"))
    return used.groupBy("route_id").agg(F.min_by("shape_id", F.struct(-F.col("_trips"), "shape_id")).alias("shape_id"))


def stop_sequences(stop_times: DataFrame, canonical: DataFrame) -> DataFrame:
    """First occurrence of each stop on the canonical shape and its share of the shape's length."""
    on_shape = stop_times.join(canonical, ["route_id", "shape_id"], "left_semi")
    # the stop times are read once: a route's length is the largest of its stops' rows
    first = materialize(on_shape.groupBy("route_id", "stop_id").agg(
        F.min("stop_sequence").alias("stop_sequence"),
        F.min_by("shape_dist", F.struct("stop_sequence", "trip_id")).alias("shape_dist"),
        F.max("shape_dist").alias("_farthest"),
    ))
    length = first.groupBy("route_id").agg(F.max("_farthest").alias("max_dist"))
    return first.drop("_farthest").join(length, "route_id").withColumn("stop_progress", F.try_divide("shape_dist", "max_dist"))


def first_trip_route_stops(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Per route its first trip, that trip's shape and stops in order."""
    first = trips.groupBy("route_id").agg(F.min("trip_id").alias("trip_id"), F.min_by("shape_id", "trip_id").alias("shape_id"))
    stops = stop_times.select("trip_id", "stop_sequence", "stop_id").join(first.select("trip_id"), "trip_id", "left_semi")
    ordered = stops.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("_s"))
    return first.join(ordered, "trip_id", "left").select(
        "route_id", "trip_id", "shape_id", F.transform("_s", lambda s: s["stop_id"]).alias("stops")
    )


def routes_serving_stop(stop_seq: DataFrame) -> DataFrame:
    """Stop to the sorted routes serving it (a network fact: bounded by the number of routes)."""
    return stop_seq.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))


def stop_seq_norm(stop_times: DataFrame) -> DataFrame:
    """Smallest sequence number per (route, stop) and its share of the route's largest."""
    low = stop_times.groupBy("route_id", "stop_id").agg(F.min("stop_sequence").alias("seq"))
    top = Window.partitionBy("route_id")  # one row per stop of the route
    return low.withColumn("seq_norm", F.col("seq") / F.max("seq").over(top))


def trip_stop_index(stop_times: DataFrame) -> DataFrame:
    """Per trip its stop ids in order."""
    return stop_times.groupBy("trip_id").agg(
        F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("_s")
    ).select("trip_id", F.transform("_s", lambda s: s["stop_id"]).alias("trip_stops"))


def stops_remaining(df: DataFrame, index: DataFrame, current: str, target: str) -> DataFrame:
    """Stops between current and target on the trip; wraps on loops, 0 when either is unknown."""
    here = F.array_position("trip_stops", F.col(current))
    there = F.array_position("trip_stops", F.col(target))
    left = F.when(there > here, there - here).otherwise(F.size("trip_stops") - here + there)
    return df.join(index, "trip_id", "left").select(
        *df.columns, F.when((here > 0) & (there > 0), left).otherwise(F.lit(0)).cast("long").alias("stops_remaining")
    )


def next_n_stops(df: DataFrame, index: DataFrame, current: str, n: int = 3) -> DataFrame:
    """The following ``n`` stops of the trip; none when the current stop is not on it."""
    at = F.array_position("trip_stops", F.col(current)).cast("int")
    following = F.when(at > 0, F.slice("trip_stops", at + 1, n)).otherwise(F.array().cast("array<bigint>"))
    return df.join(index, "trip_id", "left").select(*df.columns, following.alias("next_stops"))


def learn_pattern_trip(df: DataFrame, order: str) -> DataFrame:
    """Trip last seen with each pattern."""
    return df.groupBy("pattern_id").agg(F.max_by("trip_id", F.struct(order, "trip_id")).alias("trip_id"))


def route_catalog(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """All routes with their number of trips."""
    per = trips.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_trips"))
    return routes.join(per, "route_id", "left").withColumn("n_trips", F.coalesce("n_trips", F.lit(0)))


def route_polyline(trips: DataFrame, shapes: DataFrame, shape_of) -> DataFrame:
    """One polyline per route: its first trip's shape, points in order."""
    first = trips.groupBy("route_id").agg(F.min_by("shape_id", "trip_id").alias("shape_id"))
    points = first.withColumn("shape_id", shape_of(F.col("shape_id"))).join(shapes, "shape_id")
    return points.select("route_id", "shape_id", "seq", "lat", "lon")


WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_active(calendar: DataFrame, day, weekday) -> DataFrame:
    """Calendar rows running on a day: inside the date range and flagged for its weekday (Monday 0)."""
    flags = F.array(*[F.col(d) for d in WEEKDAYS])
    return calendar.where(day.between(F.col("start_day"), F.col("end_day")) & (F.get(flags, weekday) == 1))


def services_by_day(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """(day, service) for every day seen in the facts; each calendar row meets these days only, however long its range is.

    The days seen are broadcast: there are 36 525 of 8 bytes in a century.
    """
    days = F.broadcast(facts.select("day").distinct())
    weekday = F.pmod(F.col("day") + 3, F.lit(7)).cast("int")
    return service_active(calendar.drop("day").crossJoin(days), F.col("day"), weekday).select("day", "service_id")
