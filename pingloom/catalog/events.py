"""Trajectory events (E*)."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import query, rounded
from pingloom.operators import events as E

TRACK_W = "(PARTITION BY vehicle_id, route_id ORDER BY ts_ms, event_id)"
VEH_W = "(PARTITION BY vehicle_id ORDER BY ts_ms, event_id)"


@query("e1_stop_transitions", f"""
    SELECT event_id, last_stop_id, prev_value, prev_ts_ms FROM (SELECT *, lag(last_stop_id) OVER w AS prev_value, lag(ts_ms) OVER w AS prev_ts_ms FROM pings WINDOW w AS {TRACK_W})
    WHERE prev_value <> last_stop_id""")
def _(t):
    return E.stop_transitions(t.pings).select("event_id", "last_stop_id", "prev_value", "prev_ts_ms")


IDLE = f"""
    f AS (SELECT *, CASE WHEN speed < 40 THEN 1 ELSE 0 END AS idle FROM pings),
    c AS (SELECT *, CASE WHEN lag(ts_ms) OVER w IS NULL OR lag(idle) OVER w <> idle OR ts_ms - lag(ts_ms) OVER w > 43200000 THEN 1 ELSE 0 END AS brk FROM f WINDOW w AS {TRACK_W}),
    s AS (SELECT *, sum(brk) OVER w AS streak FROM c WINDOW w AS {TRACK_W})"""


@query("e2_idle_streaks", f"WITH {IDLE} SELECT event_id, idle AS is_idle_gps, CASE WHEN idle = 1 THEN (ts_ms - min(ts_ms) OVER (PARTITION BY vehicle_id, route_id, streak)) / 1000 ELSE 0 END AS seconds_idle FROM s")
def _(t):
    return E.idle_streaks(t.pings, "speed", idle_below=40.0, max_gap_ms=43_200_000).select("event_id", "is_idle_gps", "seconds_idle")


TRAVEL = f"""
    tr AS (SELECT * FROM (SELECT *, lag(last_stop_id) OVER w AS ps FROM pings WINDOW w AS {TRACK_W}) WHERE ps <> last_stop_id),
    tv AS (SELECT *, lag(ts_ms) OVER w AS pt FROM tr WINDOW w AS {TRACK_W}),
    travel AS (SELECT * EXCLUDE (ps, pt), (ts_ms - pt) / 1000 AS segment_s, (((ts_ms // 3600000) - 6) % 24)::INTEGER AS hour_ct, CASE WHEN (ts_ms // 86400000 + 3) % 7 < 5 THEN 1 ELSE 0 END AS day_type
               FROM tv WHERE ts_ms > pt AND ts_ms - pt <= 86400000)"""


@query("e3_segment_travel", f"WITH {TRAVEL} SELECT event_id, last_stop_id, segment_s FROM travel")
def _(t):
    return E.segment_travel(t.pings, max_ms=86_400_000).select("event_id", "last_stop_id", "segment_s")


DWELL = f"""
    ch AS (SELECT *, CASE WHEN lag(last_stop_id) OVER w <> last_stop_id THEN 1 ELSE 0 END AS chg FROM pings WINDOW w AS {TRACK_W}),
    gr AS (SELECT *, sum(chg) OVER w AS grp FROM ch WINDOW w AS {TRACK_W}),
    dw AS (SELECT vehicle_id, route_id, grp, min(ts_ms) AS arrival_ms, arg_min(last_stop_id, ts_ms) AS stop_id, min(ts_ms) FILTER (speed >= 60) AS leave, max(ts_ms) AS last_ms FROM gr WHERE grp > 0 GROUP BY ALL),
    dwells AS (SELECT vehicle_id, route_id, stop_id, arrival_ms, (coalesce(leave, last_ms) - arrival_ms) / 1000 AS dwell_s FROM dw
               WHERE coalesce(leave, last_ms) > arrival_ms AND coalesce(leave, last_ms) - arrival_ms <= 259200000)"""


@query("e4_dwell_events", f"WITH {DWELL} SELECT * FROM dwells")
def _(t):
    return E.dwell_events(t.pings, "speed", moving_from=60.0, max_ms=3 * 86_400_000)


@query("e5_detect_arrivals", f"""
    SELECT vehicle_id, event_id, ts_ms, last_stop_id AS stop_id, coalesce(last_stop_time_ms, ts_ms) AS arrival_ms
    FROM (SELECT *, lag(last_stop_id) OVER w AS ps FROM pings WINDOW w AS {VEH_W}) WHERE last_stop_id <> 0 AND last_stop_id IS DISTINCT FROM nullif(ps, 0)""")
def _(t):
    return E.detect_arrivals(t.pings)


RUNS = f"""
    b AS (SELECT *, passenger_load // 30 AS side FROM pings),
    c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR lag(side) OVER w <> side THEN 1 ELSE 0 END AS brk FROM b WINDOW w AS {VEH_W}),
    r AS (SELECT *, sum(brk) OVER w AS run FROM c WINDOW w AS {VEH_W})"""


@query("e6_approach_sequences", f"""
    WITH {RUNS} SELECT vehicle_id, any_value(side) AS stop_id, min(ts_ms) AS run_start_ms, max(ts_ms) AS run_end_ms, count(*) AS n_pings FROM r GROUP BY vehicle_id, run HAVING count(*) >= 3""")
def _(t):
    return E.approach_sequences(t.pings.withColumn("side", F.floor(F.col("passenger_load") / 30)), "side")


@query("e7_label_by_transition", f"""
    WITH c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR lag(next_stop_id) OVER w <> next_stop_id THEN 1 ELSE 0 END AS brk FROM pings WINDOW w AS {VEH_W}),
         r AS (SELECT *, sum(brk) OVER w AS run FROM c WINDOW w AS {VEH_W}),
         g AS (SELECT vehicle_id, run, any_value(next_stop_id) AS stop_id, min(ts_ms) AS start_ms FROM r GROUP BY ALL),
         e AS (SELECT *, lead(start_ms) OVER (PARTITION BY vehicle_id ORDER BY run) AS end_ms FROM g),
         m AS (SELECT e.vehicle_id, e.run, min(a.arrival_ms) AS hit FROM e JOIN arrivals a ON a.vehicle_id = e.vehicle_id AND a.stop_id = e.stop_id
               AND a.arrival_ms BETWEEN e.end_ms - 172800000 AND e.end_ms + 259200000 WHERE e.stop_id <> 0 GROUP BY ALL)
    SELECT r.event_id, m.hit AS matched_ms, (m.hit - r.ts_ms) / 1000 AS label_s FROM r JOIN m USING (vehicle_id, run) WHERE (m.hit - r.ts_ms) / 1000 > 3600 AND (m.hit - r.ts_ms) / 1000 < 432000""")
def _(t):
    out = E.label_by_transition(t.pings, t.arrivals, before_ms=172_800_000, after_ms=259_200_000, low_s=3600, high_s=432_000)
    return out.select("event_id", "matched_ms", "label_s")


@query("e8_label_by_lookback", f"""
    WITH a AS (SELECT vehicle_id, last_stop_id AS stop_id, ts_ms AS seen, event_id AS seen_id, coalesce(last_stop_time_ms, ts_ms) AS arrival_ms
               FROM (SELECT *, nullif(lag(last_stop_id) OVER w, 0) AS ps FROM pings WINDOW w AS {VEH_W}) WHERE last_stop_id <> 0 AND ps IS NOT NULL AND last_stop_id <> ps)
    SELECT p.vehicle_id, p.event_id, p.next_stop_id AS stop_id, p.ts_ms, a.arrival_ms, (a.arrival_ms - p.ts_ms) / 1000 AS label_s
    FROM pings p JOIN a ON a.vehicle_id = p.vehicle_id AND a.stop_id = p.next_stop_id AND p.next_stop_id <> 0 AND (p.ts_ms < a.seen OR (p.ts_ms = a.seen AND p.event_id < a.seen_id))
      AND a.arrival_ms - p.ts_ms BETWEEN 0 AND 259200000""")
def _(t):
    return E.label_by_lookback(t.pings, max_ms=259_200_000)


@query("e9_downsample_last", """
    SELECT vehicle_id, route_id, ts_ms // 86400000 * 86400000 AS bucket_ms, arg_max(event_id, ts_ms * 1000000 + event_id) AS event_id, arg_max(speed, ts_ms * 1000000 + event_id) AS speed,
           arg_max(last_stop_on_time, ts_ms * 1000000 + event_id) FILTER (last_stop_on_time IS NOT NULL) AS last_stop_on_time,
           arg_max(eta_minutes, ts_ms * 1000000 + event_id) FILTER (eta_minutes IS NOT NULL) AS eta_minutes
    FROM pings GROUP BY ALL""")
def _(t):
    out = E.downsample_last(t.pings, bucket_ms=86_400_000)
    return out.select("vehicle_id", "route_id", "bucket_ms", "event_id", "speed", "last_stop_on_time", "eta_minutes")


@query("e10_transition_timing", f"""
    WITH tr AS (SELECT vehicle_id, ts_ms, ps AS stop_id, pt FROM (SELECT *, lag(next_stop_id) OVER w AS ps, lag(ts_ms) OVER w AS pt FROM pings WINDOW w AS {VEH_W}) WHERE ps <> next_stop_id AND ps <> 0),
         d AS (SELECT (tr.ts_ms - a.arrival_ms) / 1000 AS d FROM tr ASOF JOIN arrivals a ON a.vehicle_id = tr.vehicle_id AND a.stop_id = tr.stop_id AND tr.pt < a.arrival_ms WHERE a.arrival_ms - tr.pt <= 864000000)
    SELECT count(*) AS n, round(avg(d), 3) AS mean_s, round(stddev_pop(d), 3) AS std_s, min(d) AS min_s, max(d) AS max_s, count_if(d < -3600)::BIGINT AS n_early, count_if(d > 3600)::BIGINT AS n_late,
           count_if(d BETWEEN -3600 AND 3600)::BIGINT AS n_on_time FROM d""")
def _(t):
    return rounded(E.transition_timing(t.pings, t.arrivals, reach_ms=864_000_000, near_s=3600.0), 3)
