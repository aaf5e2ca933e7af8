"""Per-vehicle windows (W*)."""

from pyspark.sql import functions as F

from pingloom.catalog.geo import hav
from pingloom.catalog.registry import query, rounded
from pingloom.operators import windows as W

DAY = 86_400_000
ORDER = ["ts_ms", "event_id"]
SPEED = f"""
    l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts_ms) OVER w AS pts FROM pings WINDOW w AS (PARTITION BY vehicle_id, route_id ORDER BY ts_ms, event_id)),
    g AS (SELECT * EXCLUDE (plat, plon, pts), CASE WHEN ts_ms - pts BETWEEN 60000 AND 43200000 THEN least({hav('plat', 'plon', 'lat', 'lon')} / ((ts_ms - pts) / 1000), 2.5) END AS gps FROM l)"""


def gps(t):
    """Speeds with limits that fit vehicles reporting every ten hours."""
    return W.gps_speed(t.pings, min_delta_ms=60_000, max_gap_ms=12 * 3_600_000, cap=2.5)


@query("w1_lag_by", "SELECT event_id, lag(ts_ms) OVER w AS prev_ts, lag(last_stop_id) OVER w AS prev_stop FROM pings WINDOW w AS (PARTITION BY vehicle_id, route_id ORDER BY ts_ms, event_id)")
def _(t):
    return W.lag_by(t.pings, W.TRACK, "ts_ms", ORDER, {"prev_ts": "ts_ms", "prev_stop": "last_stop_id"}).select("event_id", "prev_ts", "prev_stop")


@query("w2_gps_speed", f"WITH {SPEED} SELECT event_id, round(gps, 6) AS gps_speed_mps FROM g")
def _(t):
    return rounded(gps(t).select("event_id", "gps_speed_mps"))


@query("w3_rolling_time", """
    SELECT event_id, round(avg(speed) OVER a, 6) AS speed_mean_43200s, round(stddev_samp(speed) OVER a, 6) AS speed_std_43200s,
           round(avg(speed) OVER b, 6) AS speed_mean_172800s, round(stddev_samp(speed) OVER b, 6) AS speed_std_172800s
    FROM pings WINDOW a AS (PARTITION BY vehicle_id, route_id ORDER BY ts_ms RANGE BETWEEN 43199999 PRECEDING AND CURRENT ROW),
                      b AS (PARTITION BY vehicle_id, route_id ORDER BY ts_ms RANGE BETWEEN 172799999 PRECEDING AND CURRENT ROW)""")
def _(t):
    out = W.rolling_time(t.pings, "speed", [43200, 172800])
    return rounded(out.select("event_id", *[f"speed_{s}_{w}s" for w in (43200, 172800) for s in ("mean", "std")]))


@query("w4_rolling_stats", f"""
    WITH l AS (SELECT *, CASE WHEN lag(lat) OVER w IS NULL THEN 0 ELSE {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} END AS step,
                      CASE WHEN lag(heading) OVER w IS NULL THEN 0 ELSE least(abs(heading - lag(heading) OVER w), 360 - abs(heading - lag(heading) OVER w)) END AS turn
               FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms, event_id))
    SELECT event_id, round(avg(speed) OVER a, 6) AS speed_avg, round(coalesce(stddev_samp(speed) OVER a, 0), 6) AS speed_std, max(speed) OVER a AS speed_max, min(speed) OVER a AS speed_min,
           round((speed - first_value(speed) OVER a) / 86400, 9) + 0.0 AS acceleration, round(sum(step) OVER a, 3) AS distance, sum(turn) OVER a AS turn_sum
    FROM l WINDOW a AS (PARTITION BY vehicle_id ORDER BY ts_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW)""")
def _(t):
    out = W.rolling_stats(t.pings, [86400])
    c = {"speed_avg": "speed_avg", "speed_std": "speed_std", "speed_max": "speed_max", "speed_min": "speed_min", "acceleration": "acceleration", "distance": "distance_traveled", "turn_sum": "heading_change"}
    return rounded(out.select("event_id", *[F.col(f"{v}_86400s").alias(k) for k, v in c.items()]), 6, acceleration=9, distance=3)


@query("w5_acceleration", f"""
    WITH {SPEED}, a AS (SELECT *, lag(gps) OVER w AS pg, lag(ts_ms) OVER w AS pt FROM g WINDOW w AS (PARTITION BY vehicle_id, route_id ORDER BY ts_ms, event_id))
    SELECT event_id, round(CASE WHEN ts_ms - pt BETWEEN 60000 AND 43200000 THEN (gps - pg) / ((ts_ms - pt) / 1000) END, 12) + 0.0 AS acceleration FROM a""")
def _(t):
    return rounded(W.acceleration(gps(t), min_delta_ms=60_000, max_gap_ms=12 * 3_600_000).select("event_id", "acceleration"), 12)


@query("w6_history_window", """
    WITH pr AS (SELECT a.event_id, a.ts_ms, a.speed, a.progress, b.ts_ms AS t, b.speed AS v, b.progress AS p
                FROM pings a JOIN pings b ON a.vehicle_id = b.vehicle_id AND b.ts_ms BETWEEN a.ts_ms - 172800000 AND a.ts_ms),
         f AS (SELECT event_id, any_value(ts_ms) AS ts_ms, any_value(speed) AS speed, any_value(progress) AS progress, count(*) AS n, min(t) AS t0, arg_min(p, t) AS p0,
                      avg(v) AS mean, min(v) AS mn, max(v) AS mx, avg(CASE WHEN v < 20 THEN 1 ELSE 0 END) AS still,
                      arg_min(v, abs(t - (ts_ms - 86400000)) * 10 + CASE WHEN t > ts_ms - 86400000 THEN 1 ELSE 0 END) AS rv,
                      arg_min(t, abs(t - (ts_ms - 86400000)) * 10 + CASE WHEN t > ts_ms - 86400000 THEN 1 ELSE 0 END) AS rt FROM pr GROUP BY event_id)
    SELECT event_id, round(CASE WHEN n >= 2 AND ts_ms > t0 THEN (progress - p0) / ((ts_ms - t0) / 1000) ELSE 0 END, 12) + 0.0 AS progress_rate,
           round(CASE WHEN n >= 2 THEN mean ELSE 0 END, 6) AS speed_rolling_mean, CASE WHEN n >= 2 THEN mn ELSE 0 END AS speed_rolling_min, CASE WHEN n >= 2 THEN mx ELSE 0 END AS speed_rolling_max,
           round(CASE WHEN n >= 2 AND ts_ms - rt > 5000 THEN speed - rv ELSE 0 END, 6) + 0.0 AS acceleration,
           round(CASE WHEN n >= 2 THEN still * ((ts_ms - t0) / 1000) ELSE 0 END, 7) AS time_stopped, CASE WHEN n >= 2 AND speed < 20 THEN 1.0::DOUBLE ELSE 0 END AS is_stopped
    FROM f""")
def _(t):
    out = W.history_window(t.pings, 172_800_000, 86_400_000, stopped=20.0)
    names = ["progress_rate", "speed_rolling_mean", "speed_rolling_min", "speed_rolling_max", "acceleration", "time_stopped", "is_stopped"]
    return rounded(out.select("event_id", *names), 6, progress_rate=12, time_stopped=7)


@query("w7_rank_ahead", "SELECT stops_away::INTEGER AS stops_away, count(*) AS n, count(DISTINCT event_id) AS n_pings FROM ahead GROUP BY 1")
def _(t):
    return t.ahead.groupBy("stops_away").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_pings"))


@query("w8_dedupe_keep_first", "SELECT vehicle_id, kind, event_id, ts_ms, speed FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id, kind ORDER BY ts_ms, event_id) = 1")
def _(t):
    return W.dedupe_keep_first(t.pings.select("vehicle_id", "kind", "event_id", "ts_ms", "speed"), ["vehicle_id", "kind"], ORDER)


@query("w9_every_nth", "SELECT event_id FROM pings QUALIFY (row_number() OVER (PARTITION BY vehicle_id, ts_ms // 86400000 ORDER BY ts_ms, event_id) - 1) % 2 = 0")
def _(t):
    return W.every_nth(t.pings.withColumn("day", F.floor(F.col("ts_ms") / DAY)), 2, ["vehicle_id", "day"], ORDER).select("event_id")


@query("w10_lead_lag_travel", """
    SELECT event_id, lag(station) OVER w AS prev_station, lag(departure_ms) OVER w AS prev_departure_ms, round((arrival_ms - lag(departure_ms) OVER w) / 1000, 3) AS travel_s
    FROM arrivals WINDOW w AS (PARTITION BY vehicle_id ORDER BY arrival_ms, event_id)""")
def _(t):
    return rounded(W.travel_between_stops(t.arrivals).select("event_id", "prev_station", "prev_departure_ms", "travel_s"), 3)


@query("w11_eta_jump_flag", """
    WITH l AS (SELECT *, lag(eta_minutes) OVER w AS pe, lag(next_stop_id) OVER w AS ps, lag(ts_ms) OVER w AS pt FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms, event_id))
    SELECT event_id, CASE WHEN ps = next_stop_id AND abs(eta_minutes - pe) * 60 > (ts_ms - pt) / 1000 + 120 THEN 1 ELSE 0 END AS eta_jump FROM l""")
def _(t):
    return W.eta_jump_flag(t.pings).select("event_id", "eta_jump")
