"""As-of, window, lookup and fan-out joins (J*), network tables."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import near, query, rounded
from pingloom.config import DAY_MS
from pingloom.functions.times import epoch_day
from pingloom.operators import clean, joins, network, tiers
from pingloom.operators.quantiles import grouped_quantiles

TWO_DAYS = 2 * DAY_MS


@query("j1_asof_median_wait", """
    WITH m AS (SELECT p.route_id, (a.arrival_ms - p.ts_ms) / 1000 AS wait_s FROM (SELECT * FROM pings WHERE speed <= 65) p
               ASOF JOIN arrivals a ON p.vehicle_id = a.vehicle_id AND p.ts_ms <= a.arrival_ms WHERE a.arrival_ms - p.ts_ms <= 86400000)
    SELECT route_id, count(*) AS n, round(median(wait_s), 3) AS median_wait_s, round(avg(wait_s), 3) AS mean_wait_s FROM m GROUP BY route_id""")
def _(t):
    pings = clean.filter_speed(t.pings).select("event_id", "vehicle_id", "route_id", "ts_ms")
    labeled = joins.asof_next(pings, t.arrivals, ["vehicle_id"], "ts_ms", "arrival_ms", DAY_MS, "next_ms")
    waits = labeled.where("next_ms IS NOT NULL").select("route_id", ((F.col("next_ms") - F.col("ts_ms")) / F.lit(1000.0)).alias("wait_s"))
    median = grouped_quantiles(waits, ["route_id"], "wait_s", {"median_wait_s": 0.5}, "n")
    return rounded(median.join(waits.groupBy("route_id").agg(F.avg("wait_s").alias("mean_wait_s")), "route_id"), 3)


@query("j1_asof_next", """
    SELECT p.event_id, CASE WHEN a.arrival_ms - p.ts_ms <= 864000000 THEN a.arrival_ms END AS next_ms FROM pings p
    ASOF LEFT JOIN arrivals a ON p.route_id = a.route_id AND p.next_stop_id = a.stop_id AND p.vehicle_id = a.vehicle_id AND p.ts_ms <= a.arrival_ms""")
def _(t):
    arrivals = t.arrivals.withColumnRenamed("stop_id", "next_stop_id")
    return joins.asof_next(t.pings, arrivals, ["route_id", "next_stop_id", "vehicle_id"], "ts_ms", "arrival_ms", 10 * DAY_MS, "next_ms").select("event_id", "next_ms")


@query("j1_asof_missing_keys", """
    SELECT p.event_id, CASE WHEN a.arrival_ms - p.ts_ms <= 864000000 THEN a.arrival_ms END AS next_ms FROM rough p
    ASOF LEFT JOIN (SELECT vehicle_id, route_id, ts_ms AS arrival_ms FROM rough WHERE kind = 'purchase') a
      ON p.route_id = a.route_id AND p.vehicle_id = a.vehicle_id AND p.ts_ms <= a.arrival_ms""")
def _(t):
    arrivals = t.rough.where("kind = 'purchase'").select("vehicle_id", "route_id", F.col("ts_ms").alias("arrival_ms"))
    return joins.asof_next(t.rough, arrivals, ["route_id", "vehicle_id"], "ts_ms", "arrival_ms", 10 * DAY_MS, "next_ms").select("event_id", "next_ms")


@query("j2_asof_next_strict", """
    SELECT p.event_id, CASE WHEN a.arrival_ms - p.ts_ms <= 172800000 THEN a.arrival_ms END AS next_ms, CASE WHEN a.arrival_ms - p.ts_ms <= 172800000 THEN a.station END AS station
    FROM pings p ASOF LEFT JOIN arrivals a ON p.vehicle_id = a.vehicle_id AND p.ts_ms < a.arrival_ms""")
def _(t):
    out = joins.asof_next(t.pings, t.arrivals, ["vehicle_id"], "ts_ms", "arrival_ms", TWO_DAYS, "next_ms", strict=True, payload=["station"])
    return out.select("event_id", "next_ms", "station")


@query("j2_asof_same_day", """
    SELECT p.event_id, a.arrival_ms AS next_ms FROM pings p
    ASOF LEFT JOIN arrivals a ON p.vehicle_id = a.vehicle_id AND p.ts_ms // 86400000 = a.arrival_ms // 86400000 AND p.ts_ms < a.arrival_ms""")
def _(t):
    by = ["vehicle_id", "day"]
    pings, arrivals = t.pings.withColumn("day", epoch_day("ts_ms")), t.arrivals.withColumn("day", epoch_day("arrival_ms"))
    return joins.asof_next(pings, arrivals, by, "ts_ms", "arrival_ms", DAY_MS, "next_ms", strict=True).select("event_id", "next_ms")


@query("j3_match_event_window", """
    SELECT p.event_id, arg_min(a.arrival_ms, abs(a.arrival_ms - p.ts_ms) * 10 + CASE WHEN a.arrival_ms > p.ts_ms THEN 1 ELSE 0 END) AS matched_ms,
           min(a.arrival_ms) AS first_ms
    FROM pings p LEFT JOIN arrivals a ON p.vehicle_id = a.vehicle_id AND p.route_id = a.route_id
      AND a.arrival_ms BETWEEN p.ts_ms - 21600000 AND p.ts_ms + 43200000
    WHERE p.kind NOT IN ('purchase', 'signup') GROUP BY p.event_id""")
def _(t):
    pings = t.pings.where("kind NOT IN ('purchase', 'signup')").select("event_id", "vehicle_id", "route_id", "ts_ms")
    by, before, after = ["vehicle_id", "route_id"], 6 * 3_600_000, 12 * 3_600_000
    nearest = joins.match_event_window(pings, t.arrivals, by, "ts_ms", "arrival_ms", before, after)
    both = joins.match_event_window(nearest, t.arrivals, by, "ts_ms", "arrival_ms", before, after, nearest=False, output="first_ms")
    return both.select("event_id", "matched_ms", "first_ms")


@query("j4_next_n_arrivals", """
    WITH r AS (SELECT p.event_id, a.arrival_ms, row_number() OVER (PARTITION BY p.event_id ORDER BY a.arrival_ms) AS rn
               FROM pings p JOIN arrivals a ON p.vehicle_id = a.vehicle_id AND a.arrival_ms > p.ts_ms AND a.arrival_ms <= p.ts_ms + 432000000)
    SELECT event_id, max(arrival_ms) FILTER (rn = 1) AS first_ms, max(arrival_ms) FILTER (rn = 2) AS second_ms, max(arrival_ms) FILTER (rn = 3) AS third_ms
    FROM r WHERE rn <= 3 GROUP BY event_id HAVING count(*) = 3""")
def _(t):
    out = joins.next_n_arrivals(t.pings, t.arrivals, ["vehicle_id"], "ts_ms", "arrival_ms", 3, 5 * DAY_MS, "event_id")
    return out.select("event_id", *[F.col("next_ms")[i].alias(n) for i, n in enumerate(("first_ms", "second_ms", "third_ms"))])


@query("j5_multi_target_asof", """
    WITH q AS (SELECT event_id, vehicle_id, ts_ms, unnest([next_stop_id, (next_stop_id + 3) % 12]) AS stop_id, unnest([0, 1]) AS pos FROM pings),
         m AS (SELECT q.event_id, q.pos, CASE WHEN a.arrival_ms - q.ts_ms <= 864000000 THEN a.arrival_ms END AS hit
               FROM q ASOF LEFT JOIN arrivals a ON q.vehicle_id = a.vehicle_id AND q.stop_id = a.stop_id AND q.ts_ms < a.arrival_ms)
    SELECT event_id, max(hit) FILTER (pos = 0) AS a0, max(hit) FILTER (pos = 1) AS a1 FROM m GROUP BY event_id""")
def _(t):
    pings = t.pings.withColumn("targets", F.array(F.col("next_stop_id"), (F.col("next_stop_id") + 3) % 12))
    out = joins.multi_target_asof(pings, "targets", t.arrivals, ["vehicle_id"], "stop_id", "ts_ms", "arrival_ms", 10 * DAY_MS, "event_id")
    return out.select("event_id", F.col("arrivals_ms")[0].alias("a0"), F.col("arrivals_ms")[1].alias("a1"))


@query("j6_explode_stops_ahead", "SELECT event_id, target_stop_id, target_stop_sequence, round(target_stop_progress, 9) AS progress, stops_away::INTEGER AS stops_away FROM ahead")
def _(t):
    return t.ahead.select("event_id", "target_stop_id", "target_stop_sequence", near(F.col("target_stop_progress"), 9).alias("progress"), "stops_away")


@query("j7_canonical_shape", "SELECT route_id, shape_id FROM canonical")
def _(t):
    return network.canonical_shape(t.stop_times)


@query("j8_stop_sequences", "SELECT route_id, stop_id, stop_sequence, shape_dist, max_dist, round(stop_progress, 9) AS stop_progress FROM stop_seq")
def _(t):
    return rounded(t.stop_seq, 9)


@query("j9_lookup_left", "SELECT order_id, supp_id, count(*) AS n, min(long_name) AS long_name FROM predictions LEFT JOIN routes ON routes.route_id = supp_id GROUP BY ALL")
def _(t):
    out = joins.lookup_left(t.predictions, t.routes.select(F.col("route_id").alias("supp_id"), "long_name"), ["supp_id"])
    return out.groupBy("order_id", "supp_id").agg(F.count(F.lit(1)).alias("n"), F.min("long_name").alias("long_name"))


@query("j10_join_weather_hour", """
    SELECT event_id, coalesce(temperature_c, (SELECT median(temperature_c) FROM weather)) AS temperature_c, coalesce(precipitation_mm, 0) AS precipitation_mm
    FROM pings p LEFT JOIN weather w ON w.hour_ms = p.ts_ms // 3600000 * 3600000""")
def _(t):
    median = grouped_quantiles(t.weather, [], "temperature_c", {"m": 0.5}).select("m").scalar()
    return rounded(joins.join_weather_hour(t.pings, t.weather, "ts_ms", median).select("event_id", "temperature_c", "precipitation_mm"))


@query("j10_weather_constants", """
    SELECT event_id, coalesce(temperature_c, 20) AS temperature_c, coalesce(precipitation_mm, 0) AS precipitation_mm
    FROM pings p LEFT JOIN weather w ON w.hour_ms = p.ts_ms // 3600000 * 3600000""")
def _(t):
    return joins.join_weather_hour(t.pings, t.weather, "ts_ms", F.lit(20.0)).select("event_id", "temperature_c", "precipitation_mm")


@query("j11_nearest_hour_weather", """
    WITH a AS (SELECT p.event_id, p.ts_ms, w.hour_ms AS before_ms FROM pings p ASOF LEFT JOIN weather w ON p.ts_ms >= w.hour_ms),
         b AS (SELECT p.event_id, w.hour_ms AS after_ms FROM pings p ASOF LEFT JOIN weather w ON p.ts_ms <= w.hour_ms),
         c AS (SELECT event_id, CASE WHEN before_ms IS NULL OR after_ms - ts_ms < ts_ms - before_ms THEN after_ms ELSE before_ms END AS weather_hour_ms FROM a JOIN b USING (event_id))
    SELECT event_id, weather_hour_ms, coalesce(temperature_c, 20) AS temperature_c FROM c LEFT JOIN weather ON hour_ms = weather_hour_ms""")
def _(t):
    return joins.nearest_hour_weather(t.pings, t.weather, "ts_ms").select("event_id", "weather_hour_ms", "temperature_c")


@query("j12_tier_cascade", """
    WITH a AS (SELECT route_id, stops_away, hour, avg(actual) AS v FROM predictions WHERE order_id % 2 = 0 GROUP BY ALL HAVING count(*) >= 60),
         b AS (SELECT route_id, stops_away, avg(actual) AS v FROM predictions WHERE order_id % 2 = 0 GROUP BY ALL HAVING count(*) >= 60),
         c AS (SELECT route_id, avg(actual) AS v FROM predictions WHERE order_id % 2 = 0 GROUP BY ALL)
    SELECT route_id, stops_away, hour, CASE WHEN a.v IS NOT NULL THEN 'A' WHEN b.v IS NOT NULL THEN 'B' ELSE 'C' END AS tier,
           round(coalesce(a.v, b.v, c.v), 5) AS estimate, count(*) AS n
    FROM predictions p LEFT JOIN a USING (route_id, stops_away, hour) LEFT JOIN b USING (route_id, stops_away) LEFT JOIN c USING (route_id)
    GROUP BY ALL""")
def _(t):
    config = tiers.TierConfig("slots", (tiers.Tier("A", ("route_id", "stops_away", "hour")), tiers.Tier("B", ("route_id", "stops_away")), tiers.Tier("C", ("route_id",))), 60, "mean")
    rows = t.predictions.withColumn(tiers.E, F.lit(0))
    cells = tiers.tier_fit(rows.where("order_id % 2 = 0"), config, "actual")
    out = tiers.tier_apply(rows, cells, config, output="estimate")
    return rounded(out.groupBy("route_id", "stops_away", "hour", "tier", "estimate").agg(F.count(F.lit(1)).alias("n")), 5)


@query("j13_first_trip_route_stops", """
    WITH f AS (SELECT route_id, min(trip_id) AS trip_id, arg_min(shape_id, trip_id) AS shape_id FROM trips GROUP BY route_id)
    SELECT f.route_id, f.trip_id, f.shape_id, string_agg(s.stop_id, ',' ORDER BY stop_sequence) AS stops
    FROM f LEFT JOIN stop_times s ON s.trip_id = f.trip_id GROUP BY ALL""")
def _(t):
    return network.first_trip_route_stops(t.trips, t.stop_times).withColumn("stops", F.array_join(F.col("stops").cast("array<string>"), ","))


@query("j14_routes_serving_stop", "SELECT stop_id, string_agg(DISTINCT route_id, ',' ORDER BY route_id) AS routes FROM stop_seq GROUP BY stop_id")
def _(t):
    return network.routes_serving_stop(t.stop_seq).withColumn("routes", F.array_join(F.col("routes").cast("array<string>"), ","))


@query("j15_enrich_positions", """
    WITH pos AS (SELECT event_id, event_id % 7000 AS trip_id, CASE WHEN event_id % 3 = 0 THEN next_stop_id END AS next_stop_id FROM pings),
         e AS (SELECT o_orderkey AS trip_id, o_custkey % 12 AS stop, (o_orderkey * 11) % 900 AS eta, (o_orderkey * 3) % 700 - 200 AS delay FROM orders)
    SELECT event_id, pos.trip_id, coalesce(pos.next_stop_id, stop) AS next_stop_id, coalesce(eta, 0) AS eta_seconds,
           CASE WHEN delay <= 0 THEN 1 ELSE 0 END AS on_time, CASE WHEN delay > 300 THEN 1 ELSE 0 END AS is_delayed
    FROM pos LEFT JOIN e ON e.trip_id = pos.trip_id""")
def _(t):
    e = F.col("event_id")
    positions = t.pings.select("event_id", (e % 7000).alias("trip_id"), F.when(e % 3 == 0, F.col("next_stop_id")).alias("next_stop_id"))
    k = F.col("o_orderkey")
    etas = t.raw("orders").select(k.alias("trip_id"), (F.col("o_custkey") % 12).alias("next_stop_id"), ((k * 11) % 900).alias("eta_seconds"), ((k * 3) % 700 - 200).alias("delay"))
    return joins.enrich_positions(positions, etas)


LIVE = "SELECT vehicle_id, route_id, next_stop_id, (event_id * 7) % 1500 AS eta_seconds FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms DESC, event_id DESC) = 1"


def live(t):
    from pingloom.streaming.live import latest_positions

    return latest_positions(t.pings.select("vehicle_id", "route_id", "event_id", "ts_ms", "next_stop_id")).withColumn("eta_seconds", (F.col("event_id") * 7) % 1500)


@query("j16_eta_board", f"""
    WITH p AS ({LIVE}), b AS (SELECT route_id, next_stop_id AS stop_id, min(eta_seconds) AS min_eta,
               string_agg(CASE WHEN eta_seconds < 60 THEN '< 1 min' ELSE CAST(floor(eta_seconds / 60 + 0.5) AS BIGINT) || ' min' END, ' · ' ORDER BY eta_seconds) AS txt FROM p GROUP BY ALL)
    SELECT s.route_id, s.stop_id, coalesce(txt, 'No buses en route') AS eta_text, min_eta FROM stop_seq s LEFT JOIN b ON b.route_id = s.route_id AND b.stop_id = s.stop_id""")
def _(t):
    return joins.eta_board(t.stop_seq.select("route_id", "stop_id"), live(t))


@query("a18_active_vehicle_counts", f"""
    WITH p AS ({LIVE}), c AS (SELECT r.route_id, long_name, color, count(p.vehicle_id) AS n_vehicles FROM routes r LEFT JOIN p ON p.route_id = r.route_id GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY CASE WHEN n_vehicles = 0 THEN 1 ELSE 0 END, long_name, route_id)::INTEGER AS position FROM c""")
def _(t):
    from pingloom.operators.history import active_vehicle_counts

    return active_vehicle_counts(t.routes, live(t))


@query("src8_stop_times_with_trip", """
    SELECT s.l_orderkey AS trip_id, route_id, shape_id, count(*) AS n FROM lineitem s LEFT JOIN (SELECT DISTINCT * FROM trips WHERE service_id <> 'P') t ON t.trip_id = s.l_orderkey GROUP BY ALL""")
def _(t):
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("trip_id"), "l_linenumber")
    out = network.stop_times_with_trip(lines, t.trips.where("service_id <> 'P'"))
    return out.groupBy("trip_id", "route_id", "shape_id").agg(F.count(F.lit(1)).alias("n"))


@query("snk5_route_catalog", "SELECT r.route_id, long_name, color, count(trip_id) AS n_trips FROM routes r LEFT JOIN trips t ON t.route_id = r.route_id GROUP BY ALL")
def _(t):
    return network.route_catalog(t.routes, t.trips)


@query("snk5_route_polyline", """
    WITH f AS (SELECT route_id, arg_min(shape_id, trip_id) // 5 AS shape_id FROM trips GROUP BY route_id)
    SELECT route_id, f.shape_id, seq, lat, lon FROM f JOIN shapes s ON s.shape_id = f.shape_id""")
def _(t):
    return network.route_polyline(t.trips, t.shapes, lambda s: F.floor(s / 5).cast("long"))


@query("t5_service_active", """
    WITH c AS (SELECT s_suppkey AS service_id, s_suppkey % 2 AS monday, s_suppkey % 3 AS tuesday, s_nationkey % 2 AS wednesday, 1 AS thursday, s_suppkey % 5 AS friday, 0 AS saturday, 0 AS sunday,
                      19700 + s_suppkey AS start_day, 19740 + s_suppkey * 2 AS end_day FROM supplier),
         d AS (SELECT DISTINCT ts_ms // 86400000 AS day FROM pings)
    SELECT day, service_id FROM d JOIN c ON day BETWEEN start_day AND end_day
      AND [monday, tuesday, wednesday, thursday, friday, saturday, sunday][((day + 3) % 7) + 1] = 1""")
def _(t):
    k = F.col("s_suppkey")
    calendar = t.raw("supplier").select(
        k.alias("service_id"), (k % 2).alias("monday"), (k % 3).alias("tuesday"), (F.col("s_nationkey") % 2).cast("long").alias("wednesday"),
        F.lit(1).cast("long").alias("thursday"), (k % 5).alias("friday"), F.lit(0).cast("long").alias("saturday"), F.lit(0).cast("long").alias("sunday"),
        (k + 19700).alias("start_day"), (k * 2 + 19740).alias("end_day"))
    return network.services_by_day(t.pings.select(epoch_day("ts_ms").alias("day")), calendar)
