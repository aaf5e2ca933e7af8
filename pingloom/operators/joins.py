"""As-of, window, lookup and fan-out joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS, HOUR_MS
from pingloom.functions.scalars import eta_text
from pingloom.functions.times import floor_div
from pingloom.plans.slices import SLICE, reach_slice


def asof_next(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_ms: str, right_ms: str, tolerance_ms: int,
    output: str, strict: bool = False, payload: Sequence[str] = (),
) -> DataFrame:
    """Forward as-of join: the first right time at or after (``strict``: after) the left one.

    Both sides go through one shuffle on (keys, time slice); a right row is copied into the earlier
    slice it can serve. One descending pass carries the nearest following right row, so the cost is
    a sort, not a frame per row, and a hot key is spread over its slices.

    As in any join a NULL key or time matches nothing: such left rows stay, unmatched and spread by
    their hash; such right rows go.
    """
    size = reach_slice(tolerance_ms)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, left_ms)])
    row = left.select(
        "*", F.col(left_ms).alias("_ms"), F.when(known, floor_div(left_ms, size)).otherwise(F.xxhash64(*left.columns)).alias(SLICE), F.lit(False).alias("_right")
    )
    first = floor_div(F.col(right_ms) - F.lit(tolerance_ms), size)
    event = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, right_ms)])).select(
        *by, F.col(right_ms).alias("_ms"),
        F.explode(F.sequence(first, floor_div(right_ms, size))).alias(SLICE), F.lit(True).alias("_right"),
        F.struct(F.col(right_ms).alias("_at"), *payload).alias("_event"),
    )
    both = row.unionByName(event, allowMissingColumns=True)
    # walking back in time: at equal times the right row must be seen first, unless strict
    at_tie = F.col("_right") if strict else ~F.col("_right")
    back = Window.partitionBy(*by, SLICE).orderBy(F.col("_ms").desc(), at_tie)
    nearest = F.last("_event", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    seen = both.select(*left.columns, "_ms", "_right", nearest.alias("_next")).where(~F.col("_right"))
    inside = F.col("_next._at") - F.col("_ms") <= F.lit(tolerance_ms)
    return seen.select(
        *left.columns, F.when(inside, F.col("_next._at")).alias(output),
        *[F.when(inside, F.col(f"_next.{c}")).alias(c) for c in payload],
    )


def asof_previous(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_ms: str, right_ms: str, tolerance_ms: int, output: str,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Backward as-of join: the mirror image of :func:`asof_next` on negated time."""
    flipped = asof_next(
        left.withColumn("_neg_l", -F.col(left_ms)), right.withColumn("_neg_r", -F.col(right_ms)),
        by, "_neg_l", "_neg_r", tolerance_ms, "_neg_out", payload=payload,
    )
    return flipped.withColumn(output, -F.col("_neg_out")).drop("_neg_l", "_neg_out")


def match_event_window(
    events: DataFrame, arrivals: DataFrame, by: Sequence[str], event_ms: str, arrival_ms: str,
    before_ms: int = DEFAULTS.window_before_ms, after_ms: int = DEFAULTS.window_after_ms, nearest: bool = True,
    output: str = "matched_ms",
) -> DataFrame:
    """Nearest (the earlier on a tie) or first arrival within [t - before, t + after] of each event.

    No pairs are formed: the first one is the next arrival after t - before, the nearest one is the
    closer of the last arrival until t and the next one after it.
    """
    if not nearest:
        shifted = events.withColumn("_from", F.col(event_ms) - F.lit(before_ms))
        return asof_next(shifted, arrivals, by, "_from", arrival_ms, before_ms + after_ms, output).drop("_from")
    earlier = asof_previous(events, arrivals, by, event_ms, arrival_ms, before_ms, "_before")
    both = asof_next(earlier, arrivals, by, event_ms, arrival_ms, after_ms, "_after", strict=True)
    closer = F.col("_after") - F.col(event_ms) < F.col(event_ms) - F.col("_before")
    return both.withColumn(output, F.when(F.col("_before").isNull() | closer, F.col("_after")).otherwise(F.col("_before"))).drop("_before", "_after")


def next_n_arrivals(
    pings: DataFrame, arrivals: DataFrame, by: Sequence[str], left_ms: str, right_ms: str, n: int, reach_ms: int,
    key: str,
) -> DataFrame:
    """Times of the next ``n`` arrivals after each ping within the reach; rows with fewer are dropped."""
    size = reach_slice(reach_ms)
    later = Window.partitionBy(*by, SLICE).orderBy(F.col("_ms").desc(), F.col("_is_right"))
    row = pings.select(
        key, *by, F.col(left_ms).alias("_ms"), floor_div(left_ms, size).alias(SLICE), F.lit(0).alias("_is_right")
    )
    event = arrivals.select(
        *by, F.col(right_ms).alias("_ms"),
        F.explode(F.sequence(floor_div(F.col(right_ms) - reach_ms, size), floor_div(right_ms, size))).alias(SLICE),
        F.lit(1).alias("_is_right"),
    )
    both = row.unionByName(event, allowMissingColumns=True)
    # arrivals numbered from the end of the slice; a ping knows how many lie after it
    counted = both.withColumn(
        "_after", F.sum("_is_right").over(later.rowsBetween(Window.unboundedPreceding, 0))
    )
    rows = counted.where("_is_right = 0").select(key, *by, SLICE, "_ms", F.explode(
        F.sequence(F.col("_after"), F.col("_after") - (n - 1), F.lit(-1))).alias("_pos"))
    events = counted.where("_is_right = 1").select(*by, SLICE, F.col("_after").alias("_pos"), F.col("_ms").alias("_at"))
    found = rows.join(events, [*by, SLICE, "_pos"]).where(F.col("_at") - F.col("_ms") <= reach_ms)
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list("_at")).alias("next_ms"))  # at most n each
    return listed.where(F.size("next_ms") == n)


def next_by_target(
    pings: DataFrame, arrivals: DataFrame, by: Sequence[str], target_key: str, left_ms: str, right_ms: str, tolerance_ms: int, output: str,
) -> DataFrame:
    """``pings`` with ``output``: a map from each stop of ``target_key`` to the times at which arrivals may follow the ping there.

    The arrivals of a (``by``, time slice) are folded into one map, stop -> rising times, and each ping meets that one row: pings are
    one row each in the exchange, however many targets are looked up in the map afterwards (see :func:`next_at`). Arrivals are
    copied into the slices they can serve. A ping without a key or time stays, without a map.
    """
    size = reach_slice(tolerance_ms)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, target_key, right_ms)])
    copies = F.explode(F.sequence(floor_div(F.col(right_ms) - F.lit(tolerance_ms), size), floor_div(right_ms, size))).alias(SLICE)
    served = arrivals.where(known).select(*by, target_key, F.col(right_ms).alias("_at"), copies)
    times = served.groupBy(*by, SLICE, target_key).agg(F.array_sort(F.collect_set("_at")).alias("_times"))
    maps = times.groupBy(*by, SLICE).agg(F.map_from_entries(F.collect_list(F.struct(F.col(target_key), F.col("_times")))).alias(output))
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, left_ms)])
    rows = pings.withColumn(SLICE, F.when(keyed, floor_div(left_ms, size)).otherwise(F.xxhash64(*pings.columns)))
    return rows.join(maps, [*by, SLICE], "left").select(*pings.columns, output)


def next_at(table: str, target: Column, left_ms: str, tolerance_ms: int, strict: bool = False) -> Column:
    """The first time at ``target`` at or after (``strict``: after) the ping's, within the tolerance; of :func:`next_by_target`'s map."""
    at = F.col(left_ms)
    later = F.filter(F.try_element_at(table, target), lambda t: ((t > at) if strict else (t >= at)) & (t - at <= F.lit(tolerance_ms)))
    return F.get(later, F.lit(0))


def multi_target_asof(
    pings: DataFrame, targets: str, arrivals: DataFrame, by: Sequence[str], target_key: str, left_ms: str, right_ms: str,
    tolerance_ms: int, key: str,
) -> DataFrame:
    """For an array of target stops, the first arrival at each, as an array in target order. Pings are never multiplied."""
    asked = pings.select(key, *by, left_ms, targets)
    met = next_by_target(asked, arrivals, by, target_key, left_ms, right_ms, tolerance_ms, "_next")
    return met.select(key, F.transform(targets, lambda s: next_at("_next", s, left_ms, tolerance_ms, strict=True)).alias("arrivals_ms"))


def stops_ahead(pings: DataFrame, stop_seq: DataFrame, k: int = 8, output: str = "ahead") -> DataFrame:
    """``pings`` with the next ``k`` stops on their routes as an array, nearest first: (stop_progress, stop_sequence, stop_id).

    Each route's stops are folded into one sorted array first (a route has a bounded number of stops).
    """
    line = stop_seq.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("stop_progress", "stop_sequence", "stop_id"))).alias("_line")
    )
    ahead = F.slice(F.filter("_line", lambda s: s["stop_progress"] > F.col("progress")), 1, k)
    return pings.join(line, "route_id").select(*pings.columns, ahead.alias(output))


def label_stops_ahead(
    pings: DataFrame, arrivals: DataFrame, stop_seq: DataFrame, left_ms: str, right_ms: str, tolerance_ms: int, output: str, k: int = 8,
) -> DataFrame:
    """Ping x the next ``k`` stops, each with the vehicle's next arrival there, if one follows within the tolerance.

    The fan-out comes last: pings meet the arrivals as one row each, and only stops that have an arrival become rows.
    """
    met = next_by_target(stops_ahead(pings, stop_seq, k, "_ahead"), arrivals, ["route_id", "vehicle_id"], "stop_id", left_ms, right_ms, tolerance_ms, "_next")
    labeled = F.transform("_ahead", lambda s, i: F.struct(s["stop_id"].alias("target_stop_id"), s["stop_sequence"].alias("target_stop_sequence"), s["stop_progress"].alias("target_stop_progress"),
                                                          (i + 1).alias("stops_away"), next_at("_next", s["stop_id"], left_ms, tolerance_ms).alias(output)))
    return met.select(*pings.columns, F.inline(F.filter(labeled, lambda s: s[output].isNotNull())))


def explode_stops_ahead(pings: DataFrame, stop_seq: DataFrame, k: int = 8) -> DataFrame:
    """Ping x the next ``k`` stops ahead on its route; only the wanted stops are ever emitted."""
    return stops_ahead(pings, stop_seq, k, "_ahead").select(*pings.columns, F.posexplode("_ahead").alias("_i", "_s")).select(
        *pings.columns,
        F.col("_s.stop_id").alias("target_stop_id"),
        F.col("_s.stop_sequence").alias("target_stop_sequence"),
        F.col("_s.stop_progress").alias("target_stop_progress"),
        (F.col("_i") + 1).alias("stops_away"),
    )


def lookup_left(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension join that cannot change the row count: a doubled dimension key fails the job."""
    checked = dim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in dim.columns if c not in keys]
    )
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"lookup key {list(keys)} is not unique")).cast("long")).otherwise(F.col("_n"))
    return df.join(checked.withColumn("_n", guard).where("_n = 1").drop("_n"), list(keys), "left").select(
        *df.columns, *[c for c in dim.columns if c not in keys]
    )


def join_weather_hour(
    df: DataFrame, weather: DataFrame, ts_ms: str, temperature_default: Column, precipitation_default: float = 0.0
) -> DataFrame:
    """Weather of the hour a row falls in; gaps get the given defaults."""
    hour = floor_div(ts_ms, HOUR_MS) * HOUR_MS
    return (
        df.withColumn("hour_ms", hour)
        .join(weather, "hour_ms", "left")
        .withColumn("temperature_c", F.coalesce("temperature_c", temperature_default))
        .withColumn("precipitation_mm", F.coalesce("precipitation_mm", F.lit(precipitation_default)))
    )


def nearest_hour_weather(df: DataFrame, weather: DataFrame, ts_ms: str) -> DataFrame:
    """Weather of the closest known hour, the earlier one on a tie; 20 degrees and dry without any.

    Only distinct hours are ordered (a calendar, not the facts); the facts join their hour's row.
    """
    hour = floor_div(ts_ms, HOUR_MS)
    known = weather.select(
        floor_div("hour_ms", HOUR_MS).alias("_hour"), F.struct("hour_ms", "temperature_c", "precipitation_mm").alias("_w")
    )
    hours = df.select(hour.alias("_hour")).distinct().join(known, "_hour", "full_outer")
    forth, back = (Window.partitionBy(F.lit(0)).orderBy(o) for o in (F.col("_hour"), F.col("_hour").desc()))
    options = hours.select(
        "_hour",
        F.last("_w", ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
        F.last("_w", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"),
    )
    joined = df.withColumn("_hour", hour).join(options, "_hour", "left")
    later = F.col("_b.hour_ms") - F.col(ts_ms) < F.col(ts_ms) - F.col("_a.hour_ms")
    best = F.when(F.col("_a").isNull() | later, F.col("_b")).otherwise(F.col("_a"))
    return joined.select(
        *df.columns,
        F.coalesce(best["temperature_c"], F.lit(20.0)).alias("temperature_c"),
        F.coalesce(best["precipitation_mm"], F.lit(0.0)).alias("precipitation_mm"),
        best["hour_ms"].alias("weather_hour_ms"),
    )


ROWS_A_PART = 1_000_000  # of both tables that meet


def backfill_route(df: DataFrame, trips: DataFrame, route: str = "route_id", trip: str = "trip_id") -> DataFrame:
    """Missing route ids taken from the trip.

    Rows are dealt by trip into parts of bounded size, unless few: Spark puts parts together by their compressed bytes, and what a task
    sorts and looks up (and what is grouped by trip behind it) would grow with the table.
    """
    by_trip = trips.select(F.col(trip), F.col(route).alias("_trip_route"))
    n = df.count() + trips.count()
    if n > ROWS_A_PART:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_PART))
        df, by_trip = df.repartition(parts, trip), by_trip.repartition(parts, trip)
    return lookup_left(df, by_trip, [trip]).withColumn(route, F.coalesce(route, "_trip_route")).drop("_trip_route")


def enrich_positions(positions: DataFrame, trip_eta: DataFrame) -> DataFrame:
    """Positions with their trip's ETA; the vehicle's own next stop wins over the trip's."""
    eta = trip_eta.select(
        "trip_id", F.col("next_stop_id").alias("_trip_stop"), F.col("eta_seconds").alias("_trip_eta"), "delay"
    )
    joined = positions.join(eta, "trip_id", "left")
    return joined.select(
        *[c for c in positions.columns if c != "next_stop_id"],
        F.coalesce("next_stop_id", "_trip_stop").alias("next_stop_id"),
        F.coalesce("_trip_eta", F.lit(0)).alias("eta_seconds"),
        F.coalesce((F.col("delay") <= 0).cast("int"), F.lit(0)).alias("on_time"),
        F.coalesce((F.col("delay") > 300).cast("int"), F.lit(0)).alias("is_delayed"),
    )


NO_BUS = "No buses en route"  # fixed value


def eta_board(route_stops: DataFrame, positions: DataFrame) -> DataFrame:
    """Per route stop: texts of all vehicles heading there, soonest first, or the no-bus text.

    ``positions`` holds one row per live vehicle, so a stop's list is bounded by the fleet.
    """
    heading = positions.groupBy("route_id", F.col("next_stop_id").alias("stop_id")).agg(
        F.array_sort(F.collect_list("eta_seconds")).alias("_etas"), F.min("eta_seconds").alias("min_eta")
    )
    text = F.array_join(F.transform("_etas", eta_text), " · ")
    return route_stops.join(heading, ["route_id", "stop_id"], "left").select(
        "route_id", "stop_id", F.coalesce(text, F.lit(NO_BUS)).alias("eta_text"), "min_eta"
    )
