"""Timetable features (T*)."""

from pyspark.sql import functions as F

from pingloom.catalog.history import travel
from pingloom.catalog.registry import query, rounded
from pingloom.catalog.scalars import DAYMIN, DOW
from pingloom.catalog.tiers import cascade
from pingloom.catalog.windows import SPEED
from pingloom.functions.scalars import RUSH_HOURS
from pingloom.functions.times import local_hour
from pingloom.operators import timepoints as T
from pingloom.operators import windows

# a timetable derived from the orders table: even routes, every third stop, departure by order key
TP = """
    tp AS (SELECT (o_custkey % 5) * 2 AS route_id, (o_orderkey % 4) * 3 AS stop_id, (o_orderkey * 977) % 86400 AS scheduled_s FROM orders),
    dep AS (SELECT route_id, stop_id, median(scheduled_s) AS dep FROM tp GROUP BY ALL),
    line AS (SELECT d.route_id, s.stop_sequence AS seq, dep FROM dep d JOIN stop_seq s ON s.route_id = d.route_id AND s.stop_id = d.stop_id)"""


def timetable(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(((F.col("o_custkey") % 5) * 2).alias("route_id"), ((k % 4) * 3).alias("stop_id"), ((k * 977) % 86400).alias("scheduled_s"))


@query("t1_is_timepoint", f"""
    WITH {TP} SELECT a.event_id, a.target_stop_id, CASE WHEN r.route_id IS NOT NULL THEN CASE WHEN d.stop_id IS NOT NULL THEN 1 ELSE 0 END END AS is_timepoint
    FROM ahead a LEFT JOIN dep d ON d.route_id = a.route_id AND d.stop_id = a.target_stop_id LEFT JOIN (SELECT DISTINCT route_id FROM dep) r ON r.route_id = a.route_id""")
def _(t):
    return T.is_timepoint(t.ahead, timetable(t)).select("event_id", "target_stop_id", "is_timepoint")


@query("t2_scheduled_departure", f"WITH {TP} SELECT route_id, stop_id, dep AS scheduled_departure_seconds FROM dep")
def _(t):
    return T.scheduled_departure(timetable(t))


T_SQL = f"""
    WITH {TP}, x AS (SELECT a.event_id, a.target_stop_id, a.route_id, s.stop_sequence AS here, a.target_stop_sequence AS there, (a.ts_ms // 1000 - 21600) % 86400 AS now
                     FROM ahead a LEFT JOIN stop_seq s ON s.route_id = a.route_id AND s.stop_id = a.last_stop_id)
    SELECT event_id, target_stop_id, CASE WHEN any_value(l.route_id) IS NULL THEN NULL ELSE count_if(seq > here AND seq <= there)::BIGINT END AS timepoints_remaining,
           round(arg_min(dep, seq * 1000000 + dep) FILTER (seq > here) - any_value(now), 3) AS time_until_next_timepoint_departure, round(any_value(now) - arg_max(dep, seq * 1000000 + dep) FILTER (seq <= here), 3) AS timepoint_adherence
    FROM x LEFT JOIN line l ON l.route_id = x.route_id GROUP BY event_id, target_stop_id"""


@query("t3_t4_timepoint_features", T_SQL)
def _(t):
    out = T.timepoint_features(t.ahead, timetable(t), t.stop_seq)
    return rounded(out.select("event_id", "target_stop_id", "timepoints_remaining", "time_until_next_timepoint_departure", "timepoint_adherence"), 3)


@query("t6_is_rush_hour", "SELECT event_id, CASE WHEN ((ts_ms // 3600000) - 6) % 24 IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END AS is_rush_hour FROM pings")
def _(t):
    return t.pings.select("event_id", local_hour("ts_ms").isin(*RUSH_HOURS).cast("int").alias("is_rush_hour"))


@query("t7_merge_back", """
    WITH w AS (SELECT vehicle_id, ts_ms, avg(speed) OVER (PARTITION BY vehicle_id, route_id ORDER BY ts_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS m FROM pings)
    SELECT event_id, target_stop_id, round(m, 6) AS speed_mean_86400s FROM ahead JOIN w USING (vehicle_id, ts_ms)""")
def _(t):
    rolled = windows.rolling_time(t.pings, "speed", [86400])
    return rounded(T.merge_back(t.ahead, rolled, ["speed_mean_86400s"]).select("event_id", "target_stop_id", "speed_mean_86400s"))


@query("t8_assemble_features")
def _(t):
    from dataclasses import replace

    from pingloom.config import DEFAULTS
    from pingloom.operators import features
    from pingloom.operators.quantiles import grouped_quantiles
    from pingloom.plans.stages import materialize

    wide = replace(DEFAULTS, rolling_s=DEFAULTS.rolling_s, max_gap_ms=12 * 3_600_000, history_min_obs=2)
    pings = materialize(features.ping_features(t.pings, wide))
    median = grouped_quantiles(t.weather, [], "temperature_c", {"m": 0.5}).select("m").scalar()
    rows = t.labeled.drop("day_type", "hour_ct")
    out = features.assemble_features(rows, pings, features.history_lookups(pings, wide), timetable(t), t.stop_seq, t.weather, median, "eta_minutes")
    out = features.with_baselines(out, t.train, materialize(travel(t)), t.stop_seq)
    return out.select("event_id", "target_stop_id", *features.model_inputs(out, rows), "residual")


# the columns of the assembly that other queries' SQL tells, joined row by row
VALUES = f"""
    WITH {cascade()}, {TP}, {SPEED.replace('60000 AND', '5000 AND').replace(', 2.5)', ', 29.06)')}, mt AS (SELECT median(temperature_c) AS tm FROM weather), rl AS (SELECT route_id, max(max_dist) AS l FROM stop_seq GROUP BY route_id)
    SELECT a.event_id, a.target_stop_id, round(greatest((a.target_stop_progress - a.progress) * rl.l, 0), 6) + 0.0 AS distance_to_target, CASE WHEN a.eta_minutes IS NOT NULL THEN greatest(a.eta_minutes, 0) END AS scheduled_time_to_target,
           a.speed AS current_speed, a.stops_away AS stops_remaining, a.target_stop_sequence AS stop_index, {DAYMIN.replace('ts_ms', 'a.ts_ms')}::INTEGER AS minutes_since_midnight, {DOW.replace('ts_ms', 'a.ts_ms')}::INTEGER AS day_of_week,
           coalesce(precipitation_mm, 0) AS precipitation_mm, coalesce(temperature_c, tm) AS temperature_c, CASE WHEN a.speed <= 2 THEN 1 ELSE 0 END AS is_idle, round(g.gps, 6) AS gps_speed_mps,
           dep.dep AS scheduled_departure_seconds, CASE WHEN dr.route_id IS NOT NULL THEN CASE WHEN dep.dep IS NOT NULL THEN 1 ELSE 0 END END AS is_timepoint, tf.timepoints_remaining, tf.time_until_next_timepoint_departure, tf.timepoint_adherence, CASE WHEN a.hour_ct IN ({', '.join(map(str, RUSH_HOURS))}) THEN 1 ELSE 0 END AS is_rush_hour,
           round(sc.baseline_s2s, 6) AS baseline_s2s, round(sc.estimate, 6) AS baseline_eta, round(a.label_s - sc.estimate, 6) + 0.0 AS residual
    FROM labeled a JOIN sc ON sc.event_id = a.event_id AND sc.target_stop_id = a.target_stop_id JOIN rl ON rl.route_id = a.route_id CROSS JOIN mt LEFT JOIN weather w ON w.hour_ms = a.ts_ms // 3600000 * 3600000
    LEFT JOIN g ON g.event_id = a.event_id LEFT JOIN dep ON dep.route_id = a.route_id AND dep.stop_id = a.target_stop_id
    LEFT JOIN (SELECT DISTINCT route_id FROM dep) dr ON dr.route_id = a.route_id LEFT JOIN ({T_SQL}) tf ON tf.event_id = a.event_id AND tf.target_stop_id = a.target_stop_id"""


@query("t8_values", VALUES)
def _(t):
    names = ["event_id", "target_stop_id", "distance_to_target", "scheduled_time_to_target", "current_speed", "stops_remaining", "stop_index", "minutes_since_midnight", "day_of_week", "precipitation_mm",
             "temperature_c", "is_idle", "gps_speed_mps", "scheduled_departure_seconds", "is_timepoint", "timepoints_remaining", "time_until_next_timepoint_departure", "timepoint_adherence", "is_rush_hour", "baseline_s2s", "baseline_eta", "residual"]
    return rounded(from_t8(t).select(*names), 6, time_until_next_timepoint_departure=3, timepoint_adherence=3)


@query("t8_rows_and_columns", "SELECT count(*) AS rows, 45 AS inputs FROM labeled")
def _(t):
    out = from_t8(t)
    inputs = [c for c in out.columns if c not in ("event_id", "target_stop_id", "residual")]
    from pingloom.operators import features

    return features.check_assembly(out, t.labeled).withColumn("inputs", F.lit(len(inputs)))


def from_t8(t):
    from pingloom.catalog.registry import ENTRIES

    return ENTRIES["t8_assemble_features"].build(t)
