"""Historical aggregates and their joins (A1-A9, A13, A17), coverage (Q15)."""

import uuid

from pyspark.sql import functions as F

from pingloom.catalog.events import DWELL, TRAVEL
from pingloom.catalog.registry import query, rounded
from pingloom.catalog.windows import SPEED, gps
from pingloom.config import HOUR_MS
from pingloom.functions.times import epoch_day, local_hour, weekday
from pingloom.operators import events, history, summaries, windows
from pingloom.plans.relabel import TEST_DAYS, TRAIN_DAYS
from pingloom.plans.stages import materialize, run_folder

CELL_SQL = "(((ts_ms // 3600000) - 6) % 24)::INTEGER AS hour_ct, CASE WHEN (ts_ms // 86400000 + 3) % 7 < 5 THEN 1 ELSE 0 END AS day_type"


def with_cell(df, ts="ts_ms"):
    return df.withColumn("hour_ct", local_hour(ts)).withColumn("day_type", (weekday(ts) < 5).cast("int"))


def travel(t):
    return with_cell(events.segment_travel(t.pings, max_ms=86_400_000))


def quartiles(prefix, value, source, keys, min_obs):
    parts = ", ".join(f"CASE WHEN count(*) >= {min_obs} THEN round(quantile_cont({value}, {q}), 6) END AS {prefix}_{n}" for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75)))
    return f"SELECT {keys}, {parts}, count(*) AS n FROM {source} GROUP BY {keys}"


@query("a1_hist_segments", f"WITH {TRAVEL} " + quartiles("segment_travel", "segment_s", "travel", "route_id, last_stop_id, hour_ct, day_type", 2))
def _(t):
    return rounded(history.hist_segments(travel(t), 2))


@query("a2_hist_dwells", f"WITH {DWELL}, dd AS (SELECT *, {CELL_SQL.replace('ts_ms', 'arrival_ms')} FROM dwells) " + quartiles("dwell", "dwell_s", "dd", "route_id, stop_id, hour_ct, day_type", 2))
def _(t):
    dwells = with_cell(events.dwell_events(t.pings, "speed", moving_from=60.0, max_ms=3 * 86_400_000), "arrival_ms")
    return rounded(history.hist_dwells(dwells, 2))


@query("a3_speed_ratio", f"""
    WITH {SPEED}, c AS (SELECT *, {CELL_SQL} FROM g),
    h AS (SELECT route_id, last_stop_id, hour_ct, day_type, CASE WHEN count(*) >= 2 THEN median(gps) END AS med FROM c WHERE gps IS NOT NULL GROUP BY ALL)
    SELECT event_id, round(CASE WHEN med > 0 THEN gps / med END, 6) AS speed_ratio FROM c LEFT JOIN h USING (route_id, last_stop_id, hour_ct, day_type)""")
def _(t):
    rows = with_cell(gps(t))
    return rounded(history.speed_ratio(rows, history.hist_speed(rows, min_obs=2)).select("event_id", "speed_ratio"))


STATION_TRAVEL = """
    st AS (SELECT *, (arrival_ms // 3600000) % 24 AS hour, lag(station) OVER w AS prev_station, (arrival_ms - lag(departure_ms) OVER w) / 1000 AS travel_s
           FROM arrivals WINDOW w AS (PARTITION BY vehicle_id ORDER BY arrival_ms, event_id)),
    seg AS (SELECT route_id, prev_station, station, hour, avg(travel_s) AS mean_s, coalesce(stddev_samp(travel_s), 0) AS std_s, count(*) AS n FROM st WHERE travel_s > 0 AND travel_s < 172800 GROUP BY ALL),
    dwl AS (SELECT station, (arrival_ms // 3600000) % 24 AS hour, avg(dwell_s) AS mean_s, coalesce(stddev_samp(dwell_s), 0) AS std_s, count(*) AS n FROM arrivals WHERE dwell_s > 0 AND dwell_s < 600 GROUP BY ALL),
    fac AS (SELECT vehicle_id, least(greatest((SELECT avg(travel_s) FROM st WHERE travel_s > 0 AND travel_s < 172800) / avg(travel_s), 0.5), 2.0) AS speed_factor FROM st WHERE travel_s > 0 AND travel_s < 172800 GROUP BY vehicle_id)"""


def station_travel(t):
    return windows.travel_between_stops(t.arrivals).withColumn("hour", F.pmod(F.floor(F.col("arrival_ms") / HOUR_MS), F.lit(24)))


def station_dwells(t):
    return history.stop_dwell(t.arrivals.withColumn("hour", F.pmod(F.floor(F.col("arrival_ms") / HOUR_MS), F.lit(24))))


@query("a4_segment_times", f"WITH {STATION_TRAVEL} SELECT route_id, prev_station, station, hour, round(mean_s, 4) AS mean_s, round(std_s, 4) AS std_s, n FROM seg")
def _(t):
    return rounded(history.segment_times(station_travel(t), max_s=172_800), 4)


@query("a5_stop_dwell", f"WITH {STATION_TRAVEL} SELECT station, hour, round(mean_s, 6) AS mean_s, round(std_s, 6) AS std_s, n FROM dwl")
def _(t):
    return rounded(station_dwells(t))


@query("a6_vehicle_speed_factor", f"WITH {STATION_TRAVEL} SELECT vehicle_id, round(speed_factor, 8) AS speed_factor FROM fac")
def _(t):
    return rounded(history.vehicle_speed_factor(station_travel(t), 172_800), 8)


def in_days(t, rows, keys, value, ms):
    """Daily summaries as a table partitioned by day, each half of the days written by itself."""
    folder = f"{run_folder(t.spark)}/{uuid.uuid4().hex}"
    dated = rows.withColumn("day", epoch_day(ms))
    for half in (0, 1):
        summaries.write_days(summaries.daily(dated.where(F.pmod("day", F.lit(2)) == half), keys, value, "day"), folder, "day")
    return summaries.read_days(t.spark, folder)


@query("a1_hist_segments_from_days", f"WITH {TRAVEL} " + quartiles("segment_travel", "segment_s", "travel", "route_id, last_stop_id, hour_ct, day_type", 2))
def _(t):
    return rounded(history.quartile_cells_from_days(in_days(t, travel(t), list(history.CELL), "segment_s", "ts_ms"), list(history.CELL), "segment_travel", 2))


@query("a4_segment_times_from_days", f"WITH {STATION_TRAVEL} SELECT route_id, prev_station, station, hour, round(mean_s, 4) AS mean_s, round(std_s, 4) AS std_s, n FROM seg")
def _(t):
    keys, rows = ["route_id", "prev_station", "station", "hour"], station_travel(t).where("travel_s > 0 AND travel_s < 172800")
    return rounded(history.moment_cells_from_days(in_days(t, rows, keys, "travel_s", "arrival_ms"), keys), 4)


@query("a5_stop_dwell_from_days", f"WITH {STATION_TRAVEL} SELECT station, hour, round(mean_s, 6) AS mean_s, round(std_s, 6) AS std_s, n FROM dwl")
def _(t):
    rows = t.arrivals.withColumn("hour", F.pmod(F.floor(F.col("arrival_ms") / HOUR_MS), F.lit(24))).where("dwell_s > 0 AND dwell_s < 600")
    return rounded(history.moment_cells_from_days(in_days(t, rows, ["station", "hour"], "dwell_s", "arrival_ms"), ["station", "hour"]))


@query("a6_speed_factor_from_days", f"WITH {STATION_TRAVEL} SELECT vehicle_id, round(speed_factor, 8) AS speed_factor FROM fac")
def _(t):
    rows = station_travel(t).where("travel_s > 0 AND travel_s < 172800")
    return rounded(history.vehicle_speed_factor_from_days(in_days(t, rows, ["vehicle_id"], "travel_s", "arrival_ms")), 8)


@query("a7_join_historical", f"""
    WITH {STATION_TRAVEL}, p AS (SELECT event_id, vehicle_id, route_id, 'Stop ' || last_stop_id AS last_station, 'Stop ' || next_stop_id AS target_station, (ts_ms // 3600000) % 24 AS hour FROM pings)
    SELECT event_id, round(coalesce(seg.mean_s, 0), 4) AS segment_avg_travel_time_sec, round(coalesce(seg.std_s, 0), 4) AS segment_std_travel_time_sec,
           round(coalesce(dwl.mean_s, 0), 6) AS stop_avg_dwell_time_sec, round(coalesce(speed_factor, 1), 8) AS vehicle_speed_factor
    FROM p LEFT JOIN seg ON seg.route_id = p.route_id AND seg.prev_station = last_station AND seg.station = target_station AND seg.hour = p.hour
    LEFT JOIN dwl ON dwl.station = target_station AND dwl.hour = p.hour LEFT JOIN fac ON fac.vehicle_id = p.vehicle_id""")
def _(t):
    pings = t.pings.select(
        "event_id", "vehicle_id", "route_id", F.concat(F.lit("Stop "), F.col("last_stop_id").cast("string")).alias("last_station"),
        F.concat(F.lit("Stop "), F.col("next_stop_id").cast("string")).alias("target_station"), F.pmod(F.floor(F.col("ts_ms") / HOUR_MS), F.lit(24)).alias("hour"))
    segments = history.segment_times(station_travel(t), max_s=172_800).where("prev_station IS NOT NULL")
    out = history.join_historical(pings, segments, station_dwells(t), history.vehicle_speed_factor(station_travel(t), 172_800))
    return rounded(out.drop("vehicle_id", "route_id", "last_station", "target_station", "hour"), 4, stop_avg_dwell_time_sec=6, vehicle_speed_factor=8)


S2S = """
    w AS (SELECT r.*, CASE WHEN td.shape_dist - ld.shape_dist > 0 THEN td.shape_dist - ld.shape_dist WHEN (target_stop_progress - progress) * len.l > 0 THEN (target_stop_progress - progress) * len.l END AS way
          FROM labeled r LEFT JOIN stop_seq ld ON ld.route_id = r.route_id AND ld.stop_id = r.last_stop_id LEFT JOIN stop_seq td ON td.route_id = r.route_id AND td.stop_id = r.target_stop_id
          LEFT JOIN (SELECT route_id, max(max_dist) AS l FROM stop_seq GROUP BY 1) len ON len.route_id = r.route_id),
    wt AS (SELECT * FROM w WHERE day BETWEEN 0 AND 19742),
    t1 AS (SELECT route_id, last_stop_id, target_stop_id, hour_ct, day_type, avg(label_s) AS t1 FROM wt GROUP BY ALL HAVING count(*) >= 2),
    t2 AS (SELECT route_id, last_stop_id, target_stop_id, day_type, avg(label_s) AS t2 FROM wt GROUP BY ALL HAVING count(*) >= 2),
    t3 AS (SELECT route_id, day_type, median(label_s / way) AS t3 FROM wt WHERE way > 0 GROUP BY ALL HAVING count(*) >= 2),
    s2s AS (SELECT w.*, coalesce(t1, t2, way * t3) AS baseline_s2s, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN way * t3 IS NOT NULL THEN 3 ELSE 0 END AS s2s_tier
            FROM w LEFT JOIN t1 USING (route_id, last_stop_id, target_stop_id, hour_ct, day_type) LEFT JOIN t2 USING (route_id, last_stop_id, target_stop_id, day_type) LEFT JOIN t3 USING (route_id, day_type))"""


def s2s(t):
    rows = history.route_progress_distance(t.labeled, t.stop_seq)
    return history.apply_s2s(rows, history.s2s_tiers(rows.where(F.col("day").between(*TRAIN_DAYS))))


@query("a8_s2s_tiers", f"""
    WITH {S2S} SELECT 1 AS tier, route_id, last_stop_id, target_stop_id, hour_ct, day_type, round(t1, 7) AS value FROM t1
    UNION ALL SELECT 2, route_id, last_stop_id, target_stop_id, NULL, day_type, round(t2, 7) FROM t2 UNION ALL SELECT 3, route_id, NULL, NULL, NULL, day_type, round(t3, 7) FROM t3""")
def _(t):
    rows = history.route_progress_distance(t.train, t.stop_seq)
    t1, t2, t3 = history.s2s_tiers(rows)
    out = t1.withColumnRenamed("t1", "value").withColumn("tier", F.lit(1))
    out = out.unionByName(t2.withColumnRenamed("t2", "value").withColumn("tier", F.lit(2)), allowMissingColumns=True)
    return rounded(out.unionByName(t3.withColumnRenamed("t3", "value").withColumn("tier", F.lit(3)), allowMissingColumns=True), 7)


@query("a9_apply_s2s", f"WITH {S2S} SELECT event_id, target_stop_id, round(way, 6) AS way, round(baseline_s2s, 7) AS baseline_s2s, s2s_tier FROM s2s WHERE day BETWEEN 19744 AND 999999")
def _(t):
    out = s2s(t).where(F.col("day").between(*TEST_DAYS))
    return rounded(out.select("event_id", "target_stop_id", "way", "baseline_s2s", "s2s_tier"), 7, way=6)


@query("a13_prorated_baseline", f"""
    WITH {TRAVEL},
    d1 AS (SELECT route_id, last_stop_id AS stop_id, day_type, median(segment_s) AS m FROM travel GROUP BY ALL HAVING count(*) >= 3),
    d2 AS (SELECT route_id, last_stop_id AS stop_id, median(segment_s) AS m FROM travel GROUP BY ALL HAVING count(*) >= 3),
    d3 AS (SELECT route_id, avg(m) AS m FROM d2 GROUP BY route_id),
    c AS (SELECT s.*, dt.day_type, coalesce(d1.m, d2.m, d3.m, 60) AS seg_s FROM stop_seq s CROSS JOIN (SELECT unnest([0, 1]) AS day_type) dt
          LEFT JOIN d1 USING (route_id, stop_id, day_type) LEFT JOIN d2 USING (route_id, stop_id) LEFT JOIN d3 USING (route_id)),
    l AS (SELECT *, row_number() OVER w AS idx, lag(shape_dist) OVER w AS prev_dist,
                 sum(seg_s) OVER (PARTITION BY route_id, day_type ORDER BY stop_sequence, stop_id ROWS UNBOUNDED PRECEDING) - first_value(seg_s) OVER w AS cum_s
          FROM c WINDOW w AS (PARTITION BY route_id, day_type ORDER BY stop_sequence, stop_id))
    SELECT r.event_id, r.target_stop_id, round(CASE WHEN b.idx >= a.idx THEN (CASE WHEN a.idx > 1 THEN CASE WHEN a.shape_dist - a.prev_dist > 0
             THEN least(1, greatest(0, a.shape_dist - r.progress * a.max_dist) / (a.shape_dist - a.prev_dist)) ELSE 0.5 END * a.seg_s ELSE 0 END) + b.cum_s - a.cum_s END, 6) AS baseline_prorated
    FROM labeled r LEFT JOIN l a ON a.route_id = r.route_id AND a.day_type = r.day_type AND a.stop_id = r.last_stop_id
    LEFT JOIN l b ON b.route_id = r.route_id AND b.day_type = r.day_type AND b.stop_id = r.target_stop_id""")
def _(t):
    segments = history.prorated_segments(t.stop_seq, materialize(travel(t)), 3)
    return rounded(history.prorated_baseline(t.labeled, segments).select("event_id", "target_stop_id", "baseline_prorated"), 6)


@query("a17_count_by_day", """
    WITH d AS (SELECT ts_ms // 86400000 AS day, count(*) AS n FROM pings GROUP BY 1) SELECT count(*) AS n_days, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) AS mean_rows FROM d""")
def _(t):
    per = t.pings.groupBy(F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(per.agg(F.count(F.lit(1)).alias("n_days"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("mean_rows")))


@query("a17_value_counts_top20", "SELECT CAST(vehicle_id AS VARCHAR) AS value, count(*) AS n FROM pings GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def _(t):
    from pingloom.operators.shift import value_counts

    return value_counts(t.pings, "vehicle_id")


@query("q15_cell_coverage", f"""
    WITH {TRAVEL}, c AS (SELECT route_id, last_stop_id, hour_ct, day_type, count(*) AS n, median(segment_s) AS m FROM travel GROUP BY ALL)
    SELECT count(*) AS n_cells, count_if(n >= 2)::BIGINT AS n_valid, count_if(n < 2)::BIGINT AS n_sparse, round(min(m) FILTER (n >= 2), 6) AS min_value, round(max(m) FILTER (n >= 2), 6) AS max_value, round(avg(m) FILTER (n >= 2), 4) AS mean_value FROM c""")
def _(t):
    return rounded(history.cell_coverage(history.hist_segments(travel(t), 2), "segment_travel_median", 2), 6, mean_value=4)
