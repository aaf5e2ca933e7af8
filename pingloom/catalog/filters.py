"""Cleaning filters and their reports (FLT*)."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import query, rounded
from pingloom.operators import clean

PING = ["event_id", "vehicle_id", "ts_ms"]


@query("flt1_filter_bbox", "SELECT event_id, vehicle_id, ts_ms FROM pings WHERE lat BETWEEN 32.5 AND 32.65 AND lon BETWEEN -85.6 AND -85.45")
def _(t):
    from pingloom.config import Box

    return clean.filter_bbox(t.pings, Box(32.5, 32.65, -85.6, -85.45)).select(*PING)


@query("flt2_filter_speed", "SELECT event_id, vehicle_id, ts_ms FROM pings WHERE speed <= 65")
def _(t):
    return clean.filter_speed(t.pings).select(*PING)


@query("flt3_filter_vehicles", "SELECT event_id, vehicle_id, ts_ms FROM pings WHERE NOT regexp_matches(vehicle_name, 'jaunt|shuttle', 'i') AND vehicle_name <> ''")
def _(t):
    return clean.filter_vehicles(t.pings).select(*PING)


@query("flt3_missing_names", "SELECT event_id, vehicle_id, ts_ms FROM rough WHERE NOT coalesce(regexp_matches(vehicle_name, 'jaunt|shuttle', 'i'), false) AND coalesce(vehicle_name <> '', true)")
def _(t):
    return clean.filter_vehicles(t.rough).select(*PING)


@query("flt3_keep_prefix", "SELECT event_id, vehicle_id, ts_ms FROM pings WHERE NOT regexp_matches(vehicle_name, 'jaunt|shuttle', 'i') AND starts_with(vehicle_name, 'bus 1')")
def _(t):
    return clean.filter_vehicles(t.pings, "bus 1").select(*PING)


@query("flt4_filter_service", """
    SELECT event_id, vehicle_id, ts_ms FROM rough WHERE pattern_id IS DISTINCT FROM 9998 AND progress IS DISTINCT FROM -1
      AND (route_id IS NULL OR route_id NOT IN (777, 230, 231, 216, 217, 218, 219, 220, 221, 222, 223, 224, 225, 226, 227, 228))""")
def _(t):
    return clean.filter_service(t.rough).select(*PING)


@query("flt5_filter_active_trips", "SELECT event_id, vehicle_id, ts_ms FROM rough WHERE status IN (7, 71) AND pattern_id IS DISTINCT FROM 9998 AND next_stop_id <> 0")
def _(t):
    return clean.filter_active_trips(t.rough).select(*PING)


@query("flt6_filter_idle", "SELECT event_id, vehicle_id, ts_ms FROM rough WHERE NOT (progress IS NOT DISTINCT FROM 0 AND speed IS NOT DISTINCT FROM 0) AND next_stop_id IS DISTINCT FROM 0 AND route_id IS DISTINCT FROM 237")
def _(t):
    return clean.filter_idle(t.rough).select(*PING)


REPORT = """
    WITH m AS (SELECT lat BETWEEN 32.5 AND 32.7 AND lon BETWEEN -85.6 AND -85.4 AS a, coalesce(speed <= 65, false) AS b,
                      coalesce(NOT regexp_matches(vehicle_name, 'jaunt|shuttle', 'i') AND vehicle_name <> '', true) AS c, pattern_id IS DISTINCT FROM 9998 AS d,
                      coalesce(route_id NOT IN (777, 230, 231) AND route_id NOT BETWEEN 216 AND 228, true) AS e, progress IS DISTINCT FROM -1 AS f FROM rough)
    SELECT count_if(NOT a)::BIGINT AS bbox, count_if(NOT b)::BIGINT AS speed, count_if(NOT c)::BIGINT AS vid,
           count_if(NOT d)::BIGINT AS pattern, count_if(NOT e)::BIGINT AS route, count_if(NOT f)::BIGINT AS progress,
           count_if(NOT (a AND b AND c AND d AND e AND f))::BIGINT AS total_removed, count_if(a AND b AND c AND d AND e AND f)::BIGINT AS kept
    FROM m"""


@query("flt7_filter_report", REPORT)
def _(t):
    return clean.filter_report(t.rough, clean.cleaning_rules())


@query("flt8_verify_filters", """
    WITH after_ AS (SELECT * FROM pings WHERE NOT regexp_matches(vehicle_name, 'jaunt|shuttle', 'i') AND vehicle_name <> ''),
         b AS (SELECT count(*) AS n FROM pings),
         bad AS (SELECT * FROM after_ WHERE regexp_matches(vehicle_name, 'jaunt|shuttle', 'i') OR pattern_id = 9998)
    SELECT n AS rows_before, (SELECT count(*) FROM after_) AS rows_after, (SELECT count(*) FROM bad) AS survivors,
           (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM (SELECT DISTINCT vehicle_name AS v FROM bad)) AS vehicles,
           round((n - (SELECT count(*) FROM after_)) / n * 100, 6) AS excluded_pct, round((SELECT count(*) FROM after_) / n * 100, 6) AS retained_pct
    FROM b""")
def _(t):
    return rounded(clean.verify_filters(t.pings, clean.filter_vehicles(t.pings)))


@query("flt9_filter_labels", "SELECT event_id, target_stop_id, label_s FROM labeled WHERE label_s > 86400 AND label_s <= 864000")
def _(t):
    return clean.filter_labels(t.labeled, "label_s", 86400, 864000).select("event_id", "target_stop_id", "label_s")


@query("flt9_label_stages", """
    SELECT count(*) AS total, count_if(schedule_eta IS NULL)::BIGINT AS no_match, count_if(schedule_eta <= 0)::BIGINT AS not_positive,
           count_if(schedule_eta > 0 AND schedule_eta <= 10)::BIGINT AS too_close, count_if(schedule_eta > 60)::BIGINT AS too_far,
           count_if(schedule_eta > 10 AND schedule_eta <= 60)::BIGINT AS kept FROM predictions""")
def _(t):
    return clean.filter_labels_report(t.predictions, "schedule_eta", 10, 60)


@query("flt10_trim_by_group_quantile", """
    WITH q AS (SELECT route_id, quantile_cont(actual, 0.995) AS lim FROM predictions GROUP BY route_id)
    SELECT route_id, count(*) AS n, round(max(actual), 6) AS max_actual FROM predictions JOIN q USING (route_id) WHERE actual <= lim GROUP BY route_id""")
def _(t):
    kept = clean.trim_by_group_quantile(t.predictions, ["route_id"], "actual")
    return rounded(kept.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.max("actual").alias("max_actual")))


@query("flt11_trim_zscore", """
    WITH s AS (SELECT avg(actual) AS m, stddev_pop(actual) AS d FROM predictions)
    SELECT route_id, count(*) AS n, round(min(actual), 6) AS low, round(max(actual), 6) AS high
    FROM predictions, s WHERE abs((actual - m) / d) <= 1.5 GROUP BY route_id""")
def _(t):
    kept = clean.trim_zscore(t.predictions, "actual", 1.5)
    return rounded(kept.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.min("actual").alias("low"), F.max("actual").alias("high")))
