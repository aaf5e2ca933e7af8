"""Live state: streams, positions, smoothing (L*)."""

from pyspark.sql import functions as F

from pingloom import schemas
from pingloom.catalog.joins import LIVE, live
from pingloom.catalog.registry import near, query, rounded
from pingloom.functions.times import local_hour
from pingloom.plans.stages import materialize
from pingloom.session import shared_folder
from pingloom.streaming import live as L

NOW = "(SELECT max(ts_ms) FROM pings)"
LATEST = "SELECT vehicle_id, event_id, ts_ms, speed, next_stop_id FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms DESC, event_id DESC) = 1"
POS = ["vehicle_id", "event_id", "ts_ms", "speed", "next_stop_id"]


def now(t):
    return t.pings.agg(F.max("ts_ms").alias("m")).scalar()


@query("l1_telemetry_stream", "SELECT vehicle_id::VARCHAR AS vid, count(*) AS n, round(sum(speed), 4) AS speed_sum FROM pings GROUP BY 1")
def _(t):
    import uuid

    folder = f"{shared_folder(t.spark)}/packets-{uuid.uuid4().hex}"
    packet = F.to_json(F.struct(F.col("ts_ms").alias("t"), F.col("vehicle_id").cast("string").alias("vid"), "lat", "lon", "speed", F.col("route_id").alias("routeId")))
    t.pings.select(packet.alias("value")).write.text(folder)
    got = L.run_available(L.telemetry_stream(t.spark, folder, schemas.TELEMETRY_FLAT))
    return rounded(got.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed_sum")), 4)


@query("l2_latest_positions", LATEST)
def _(t):
    return L.latest_positions(t.pings.select(*POS))


@query("l2_latest_positions_stream", LATEST)
def _(t):
    return L.merge_updates(L.run_available(L.latest_positions(t.streamed().pings.select(*POS)), "update"), "vehicle_id")


@query("l3_drop_stale", f"SELECT * FROM ({LATEST}) WHERE {NOW} - ts_ms <= 21600000")
def _(t):
    return L.drop_stale(L.latest_positions(t.pings.select(*POS)), now(t), 21_600_000)


@query("l4_trip_eta", """
    WITH u AS (SELECT l_orderkey AS trip_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'S' || l_partkey AS stop, epoch_us(l_shipdate) // 1000000 + l_partkey AS due, l_orderkey % 700 - 200 AS delay FROM lineitem),
         n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM u WHERE due > 1000000000 QUALIFY rn = 1)
    SELECT t.trip_id::VARCHAR AS trip_id, n.stop AS next_stop_id, coalesce(n.due - 1000000000, 0) AS eta_seconds, t.delay::INTEGER AS delay FROM (SELECT DISTINCT trip_id, delay FROM u) t LEFT JOIN n USING (trip_id)""")
def _(t):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_partkey")).alias("at"))
    updates = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(item)).alias("_u")).select(
        F.col("k").cast("string").alias("trip_id"), (F.col("k") % 700 - 200).cast("int").alias("delay"),
        F.transform("_u", lambda u: F.struct(F.concat(F.lit("S"), u["l_partkey"].cast("string")).alias("stop_id"), u["at"].alias("arrival_time"))).alias("stop_time_update"))
    return L.trip_eta(updates, F.lit(1_000_000_000))


@query("l5_enrich_stream", """
    WITH p AS (SELECT * FROM pings WHERE kind = 'click'), e AS (SELECT vehicle_id, ts_ms AS eta_ms, passenger_load AS eta_load FROM pings WHERE kind = 'error'),
         mark AS (SELECT least((SELECT max(ts_ms) FROM p), (SELECT max(eta_ms) FROM e)) - 172800000 AS wm)
    SELECT p.event_id, max(eta_ms) AS eta_ms, arg_max(eta_load, eta_ms) AS eta_load FROM p LEFT JOIN e ON e.vehicle_id = p.vehicle_id AND e.eta_ms BETWEEN p.ts_ms - 172800000 AND p.ts_ms
    GROUP BY p.event_id, p.ts_ms HAVING count(eta_ms) > 0 OR p.ts_ms <= (SELECT wm FROM mark)""")
def _(t):
    s = t.streamed().pings.withColumn("ts", F.timestamp_millis("ts_ms"))
    positions = s.where("kind = 'click'").select("event_id", F.col("vehicle_id").alias("trip_id"), "ts")
    etas = t.streamed().pings.where("kind = 'error'").select(
        F.col("vehicle_id").alias("trip_id"), F.timestamp_millis("ts_ms").alias("eta_ts"), F.col("passenger_load").alias("eta_load"))
    joined = L.run_available(L.enrich_stream(positions, etas, "2 days"))
    # a position without an ETA comes out once the watermark has passed it
    return joined.groupBy("event_id").agg(F.unix_millis(F.max("eta_ts")).alias("eta_ms"), F.max_by("eta_load", "eta_ts").alias("eta_load"))


@query("l6_history_state", """
    WITH pr AS (SELECT a.event_id, a.ts_ms, a.speed, a.progress, b.ts_ms AS t, b.speed AS v, b.progress AS p FROM pings a JOIN pings b ON a.vehicle_id = b.vehicle_id AND b.ts_ms BETWEEN a.ts_ms - 172800000 AND a.ts_ms),
         f AS (SELECT event_id, any_value(ts_ms) AS ts_ms, any_value(speed) AS speed, any_value(progress) AS progress, count(*) AS n, min(t) AS t0, arg_min(p, t) AS p0, avg(v) AS mean, min(v) AS mn, max(v) AS mx,
                      avg(CASE WHEN v < 1 THEN 1 ELSE 0 END) AS still, arg_min(v, abs(t - (ts_ms - 86400000)) * 10 + CASE WHEN t > ts_ms - 86400000 THEN 1 ELSE 0 END) AS rv,
                      arg_min(t, abs(t - (ts_ms - 86400000)) * 10 + CASE WHEN t > ts_ms - 86400000 THEN 1 ELSE 0 END) AS rt FROM pr GROUP BY event_id)
    SELECT event_id, round(CASE WHEN n >= 2 AND ts_ms > t0 THEN (progress - p0) / ((ts_ms - t0) / 1000) ELSE 0 END, 12) + 0.0 AS progress_rate, round(CASE WHEN n >= 2 THEN mean ELSE 0 END, 6) AS speed_rolling_mean,
           CASE WHEN n >= 2 THEN mn ELSE 0 END AS speed_rolling_min, CASE WHEN n >= 2 THEN mx ELSE 0 END AS speed_rolling_max, round(CASE WHEN n >= 2 AND ts_ms - rt > 5000 THEN speed - rv ELSE 0 END, 6) + 0.0 AS acceleration,
           round(CASE WHEN n >= 2 THEN still * ((ts_ms - t0) / 1000) ELSE 0 END, 7) AS time_stopped, CASE WHEN n >= 2 AND speed < 1 THEN 1.0::DOUBLE ELSE 0 END AS is_stopped FROM f""")
def _(t):
    out = L.run_available(L.history_state(t.streamed().pings, 172_800_000, 86_400_000))
    return rounded(out.drop("batch_id", "vehicle_id", "ts_ms"), 6, progress_rate=12, time_stopped=7)


SEQ = "s AS (SELECT vehicle_id, event_id, eta_minutes * 3 AS x, progress AS p, passenger_load // 30 AS side, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms, event_id) AS n FROM pings WHERE eta_minutes IS NOT NULL)"


@query("l7_ema_smooth", f"""
    WITH RECURSIVE {SEQ},
      r AS (SELECT vehicle_id, n, event_id, x, x AS v FROM s WHERE n = 1
            UNION ALL SELECT s.vehicle_id, s.n, s.event_id, s.x, CASE WHEN abs(s.x - r.v) > 1500 THEN s.x ELSE 0.3::DOUBLE * s.x + 0.7::DOUBLE * r.v END FROM r JOIN s ON s.vehicle_id = r.vehicle_id AND s.n = r.n + 1)
    SELECT vehicle_id, event_id, x AS eta_s, round(v, 6) AS smoothed_s FROM r""")
def _(t):
    rows = t.pings.where("eta_minutes IS NOT NULL").withColumn("eta_s", F.col("eta_minutes") * 3)
    return rounded(L.smooth_batch(rows, bypass_s=1500.0))


@query("l7_l8_l11_smooth_state", f"""
    WITH RECURSIVE {SEQ},
      r AS (SELECT vehicle_id, n, event_id, x, p, side, x AS v FROM s WHERE n = 1
            UNION ALL SELECT s.vehicle_id, s.n, s.event_id, s.x, s.p, s.side,
              CASE WHEN s.side <> r.side THEN s.x ELSE
                CASE WHEN s.p > r.p AND (CASE WHEN abs(s.x - r.v) > 1500 THEN s.x ELSE 0.3::DOUBLE * s.x + 0.7::DOUBLE * r.v END) > r.v + 30 THEN r.v + 30
                     ELSE CASE WHEN abs(s.x - r.v) > 1500 THEN s.x ELSE 0.3::DOUBLE * s.x + 0.7::DOUBLE * r.v END END END
            FROM r JOIN s ON s.vehicle_id = r.vehicle_id AND s.n = r.n + 1)
    SELECT vehicle_id, event_id, x AS eta_s, round(v, 6) AS smoothed_s FROM r""")
def _(t):
    rows = t.streamed().pings.where("eta_minutes IS NOT NULL").withColumn("eta_s", F.col("eta_minutes") * 3).withColumn("route_id", F.floor(F.col("passenger_load") / 30))
    out = L.run_available(L.smooth_state(rows, bypass_s=1500.0))
    return rounded(out.select("vehicle_id", "event_id", "eta_s", "smoothed_s"))


# a change of trip resets as one of route does
TRIPS = f"""
    WITH RECURSIVE s AS (SELECT vehicle_id, event_id, ts_ms, eta_minutes * 3 AS x, progress AS p, passenger_load // 30 AS side, event_id // 400 AS trip, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms, event_id) AS n FROM pings WHERE eta_minutes IS NOT NULL),
      r AS (SELECT vehicle_id, n, event_id, ts_ms, x, p, side, trip, x AS v FROM s WHERE n = 1
            UNION ALL SELECT s.vehicle_id, s.n, s.event_id, s.ts_ms, s.x, s.p, s.side, s.trip,
              CASE WHEN s.side <> r.side OR s.trip <> r.trip THEN s.x ELSE
                CASE WHEN s.p > r.p AND (CASE WHEN abs(s.x - r.v) > 1500 THEN s.x ELSE 0.3::DOUBLE * s.x + 0.7::DOUBLE * r.v END) > r.v + 30 THEN r.v + 30
                     ELSE CASE WHEN abs(s.x - r.v) > 1500 THEN s.x ELSE 0.3::DOUBLE * s.x + 0.7::DOUBLE * r.v END END END
            FROM r JOIN s ON s.vehicle_id = r.vehicle_id AND s.n = r.n + 1)"""


def trip_rows(pings):
    return pings.where("eta_minutes IS NOT NULL").withColumns({"eta_s": F.col("eta_minutes") * 3, "route_id": F.floor(F.col("passenger_load") / 30), "trip_id": F.floor(F.col("event_id") / 400)})


@query("l11_trip_change_batch", f"{TRIPS} SELECT vehicle_id, event_id, x AS eta_s, round(v, 6) AS smoothed_s FROM r")
def _(t):
    return rounded(L.smooth_state_batch(trip_rows(t.pings), bypass_s=1500.0).select("vehicle_id", "event_id", "eta_s", "smoothed_s"))


@query("l11_warm_start", f"{TRIPS} SELECT vehicle_id, event_id, x AS eta_s, round(v, 6) AS smoothed_s FROM r WHERE ts_ms // 86400000 >= 19740")
def _(t):
    """The first days as a table, the rest as a stream that goes on from its states."""
    first = L.smooth_state_batch(trip_rows(t.pings).where(F.col("ts_ms") < 19740 * 86_400_000), bypass_s=1500.0)
    later = trip_rows(t.streamed().pings).where(F.col("ts_ms") >= 19740 * 86_400_000)
    return rounded(L.run_available(L.smooth_state(later, bypass_s=1500.0, initial=first)).select("vehicle_id", "event_id", "eta_s", "smoothed_s"))


SILENT = """
    WITH g AS (SELECT vehicle_id, ts_ms, lead(ts_ms) OVER (PARTITION BY vehicle_id ORDER BY ts_ms) AS nxt FROM (SELECT DISTINCT vehicle_id, ts_ms FROM pings))
    SELECT vehicle_id, ts_ms AS last_ms, ts_ms + 172800000 AS silent_ms FROM g WHERE nxt - ts_ms > 172800000 OR (nxt IS NULL AND ts_ms + 172800000 <= (SELECT max(ts_ms) FROM pings) - 3600000)"""


@query("l6_silent_vehicles", SILENT)
def _(t):
    return L.run_available(L.silent_vehicles(t.streamed().pings, 172_800_000, "1 hour")).drop("batch_id")


@query("l6_silent_vehicles_batch", SILENT)
def _(t):
    until = t.pings.agg((F.max("ts_ms") - 3_600_000).alias("m")).scalar()
    return L.silent_vehicles_batch(t.pings, 172_800_000, until)


@query("l8_monotone_guard", """
    WITH l AS (SELECT *, lag(eta_minutes) OVER w AS pe, lag(progress) OVER w AS pp FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms, event_id))
    SELECT event_id, CASE WHEN progress > pp AND eta_minutes > pe + 30 THEN pe + 30 ELSE eta_minutes END AS guarded FROM l""")
def _(t):
    from pingloom.plans.slices import lag_across

    prev = lag_across(t.pings, ["vehicle_id"], "ts_ms", ["ts_ms", "event_id"], {"pe": "eta_minutes", "pp": "progress"})
    return prev.select("event_id", L.monotone_guard(F.col("eta_minutes"), F.col("pe"), F.col("progress"), F.col("pp")).alias("guarded"))


@query("l9_order_etas", """
    WITH c AS (SELECT event_id, least(greatest(speed * 100 - 500, 0), 3600) AS a, least(greatest(heading * 10, 0), 3600) AS b, least(greatest(passenger_load * 60, 0), 3600)::DOUBLE AS c FROM pings),
         d AS (SELECT event_id, a, CASE WHEN b < a THEN a + 30 ELSE b END AS b, c FROM c)
    SELECT event_id, round(a, 6) + 0.0 AS e1, round(b, 6) + 0.0 AS e2, round(CASE WHEN c < b THEN b + 30 ELSE c END, 6) + 0.0 AS e3 FROM d""")
def _(t):
    etas = F.array(F.col("speed") * 100 - 500, F.col("heading") * 10, (F.col("passenger_load") * 60).cast("double"))
    return t.pings.select("event_id", L.order_etas(etas).alias("e")).select("event_id", *[near(F.col("e")[i]).alias(f"e{i + 1}") for i in range(3)])


@query("l10_confidence_band", """
    SELECT order_id, part_id, supp_id, line, round(greatest(predicted - distance_m / 10 * 0.5, 0), 6) AS low_80, round(predicted + distance_m / 10, 6) AS high_80, round(predicted + distance_m / 10 * 1.5, 6) AS high_90 FROM eta""")
def _(t):
    from pingloom.functions.scalars import confidence_band

    p50, p80 = F.col("predicted"), F.col("predicted") + F.col("distance_m") / 10
    low, high = confidence_band(p50, p80, 0.8)
    return t.eta.select("order_id", "part_id", "supp_id", "line", near(low).alias("low_80"), near(high).alias("high_80"), near(confidence_band(p50, p80, 0.9)[1]).alias("high_90"))


@query("l12_positions_by_route", f"SELECT * FROM ({LIVE}) WHERE route_id = 4 OR next_stop_id = 5")
def _(t):
    return live(t).where("route_id = 4 OR next_stop_id = 5").select("vehicle_id", "route_id", "next_stop_id", "eta_seconds")


@query("l13_changed_only", "SELECT event_id, vehicle_id, ts_ms FROM pings")
def _(t):
    s = t.streamed().pings.withColumn("ts", F.timestamp_millis("ts_ms")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return L.run_available(L.changed_only(s, "ts")).select("event_id", "vehicle_id", "ts_ms")


WINDOWS = "SELECT ts_ms // 3600000 * 3600000 AS window_ms, count(*) AS n, max(ts_ms) AS last_ms FROM pings GROUP BY 1"


@query("l14_packets_per_window", WINDOWS)
def _(t):
    return L.packets_per_window(t.pings.withColumn("ts", F.timestamp_millis("ts_ms")), "ts", "1 hour")


@query("l14_packets_per_window_stream", WINDOWS)
def _(t):
    s = L.packets_per_window(t.streamed().pings.withColumn("ts", F.timestamp_millis("ts_ms")), "ts", "1 hour", "1 hour")
    return L.merge_updates(L.run_available(s, "update"), "window_ms").select("window_ms", "n", "last_ms")


@query("l15_next_stops_topk", """
    WITH m AS (SELECT event_id, unnest([next_stop_id * 7, next_stop_id * 7 + 1, next_stop_id * 900, next_stop_id]) AS stop_id, unnest([speed, heading, 3.0, 4.0]) AS minutes, unnest([0, 1, 2, 3]) AS pos FROM pings)
    SELECT event_id, pos, m.stop_id, minutes, coalesce(stop_name, 'Unknown') AS stop_name FROM m LEFT JOIN stops s ON s.stop_id = m.stop_id WHERE pos < 3""")
def _(t):
    n = F.col("next_stop_id")
    item = lambda s, m: F.struct(s.alias("stop_id"), m.alias("minutes"))
    minutes = F.array(item(n * 7, F.col("speed")), item(n * 7 + 1, F.col("heading")), item(n * 900, F.lit(3.0)), item(n, F.lit(4.0)))
    return L.next_stops_topk(t.pings.withColumn("m", minutes), "m", t.stops, "event_id").select("event_id", "pos", "stop_id", "minutes", "stop_name")


@query("l16_alerts_active", """
    WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS st, epoch_us(o_orderdate) // 1000000 AS s, epoch_us(o_orderdate) // 1000000 + (o_orderkey % 200) * 86400 AS e, o_orderpriority AS pr FROM orders)
    SELECT id::VARCHAR AS id, CASE WHEN st = 'F' THEN 'en ' || pr ELSE 'es ' || pr END AS header, CASE WHEN st = 'O' THEN '' ELSE 'plain' END AS description FROM a WHERE id % 10 = 0 OR (s <= 900000000 AND e >= 900000000)""")
def _(t):
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    text = lambda lang, x: F.struct(lang.alias("language"), x.alias("text"))
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    pr = F.col("o_orderpriority")
    alerts = t.raw("orders").select(
        k.cast("string").alias("id"),
        F.array(text(F.lit("es"), F.concat(F.lit("es "), pr)), text(F.when(st == "F", "en").otherwise("fr"), F.concat(F.lit("en "), pr))).alias("header"),
        F.when(st == "O", F.array().cast("array<struct<language: string, text: string>>")).otherwise(F.array(text(F.lit(None).cast("string"), F.lit("plain")))).alias("description"),
        F.when(k % 10 == 0, F.array().cast("array<struct<start_s: bigint, end_s: bigint>>")).otherwise(F.array(F.struct(start.alias("start_s"), (start + (k % 200) * 86400).alias("end_s")))).alias("periods"),
        F.array(pr).alias("route_ids"))
    return L.alerts_active(alerts, F.lit(900_000_000)).select("id", "header", "description")


@query("l17_service_hours_gate", "SELECT event_id FROM pings WHERE ((ts_ms // 3600000) - 6) % 24 >= 6 AND ((ts_ms // 3600000) - 6) % 24 < 22")
def _(t):
    return L.service_hours_gate(t.pings, local_hour("ts_ms")).select("event_id")


@query("l6_stream_equals_batch", "SELECT 0::BIGINT AS n_differ, count(*) AS n FROM pings")
def _(t):
    from pingloom.operators.windows import history_window

    names = ["progress_rate", "speed_rolling_mean", "speed_rolling_min", "speed_rolling_max", "acceleration", "time_stopped", "is_stopped"]
    stream = materialize(L.run_available(L.history_state(t.streamed().pings, 172_800_000, 86_400_000)).select("event_id", *[near(F.col(n), 5).alias(f"s_{n}") for n in names]))
    batch = history_window(t.pings, 172_800_000, 86_400_000).select("event_id", *names)
    differ = F.lit(False)
    for n in names:
        differ = differ | (F.abs(F.col(n) - F.col(f"s_{n}")) > 1e-4)
    return batch.join(stream, "event_id").agg(F.count_if(differ).alias("n_differ"), F.count(F.lit(1)).alias("n"))
