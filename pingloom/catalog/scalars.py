"""Scalar functions and encodings (F*)."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import near, query, rounded
from pingloom.functions import scalars as S
from pingloom.functions import times as T
from pingloom.operators import features, quality, tiers

HOUR = "((ts_ms // 3600000) % 24)"
MINUTE = "((ts_ms // 60000) % 60)"
DAYMIN = "((ts_ms // 60000) % 1440)"
DOW = "((ts_ms // 86400000 + 3) % 7)"


@query("f1_ms_ts_roundtrip", "SELECT event_id, epoch_ms(make_timestamp_ms(ts_ms)) AS ms, strftime(make_timestamp_ms(ts_ms), '%Y-%m-%d %H:%M') AS minute FROM pings")
def _(t):
    ts = T.ms_to_ts("ts_ms")
    return t.pings.select("event_id", T.ts_to_ms(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"))


@query("f2_local_hour", "SELECT event_id, CAST(((ts_ms // 3600000) - 6) % 24 AS INTEGER) AS hour_ct FROM pings")
def _(t):
    return t.pings.select("event_id", T.local_hour("ts_ms").alias("hour_ct"))


@query("f2_zone_hour", "SELECT event_id, CAST(hour(timezone('America/Chicago', timezone('UTC', make_timestamp_ms(ts_ms)))) AS INTEGER) AS hour_local FROM pings")
def _(t):
    return t.pings.select("event_id", T.hour_of(T.zone_ms("ts_ms", "America/Chicago")).alias("hour_local"))


@query("f3_calendar_parts", f"""
    SELECT event_id, {HOUR}::INTEGER AS hour, {MINUTE}::INTEGER AS minute, {DOW}::INTEGER AS day_of_week, {DAYMIN}::INTEGER AS minutes_since_midnight,
           CASE WHEN {DOW} >= 5 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN {DOW} < 5 THEN 1 ELSE 0 END AS is_weekday FROM pings""")
def _(t):
    return t.pings.select("event_id", *[c.alias(n) for n, c in T.calendar_parts("ts_ms").items()])


@query("f4_cyclical", f"""
    SELECT event_id, round(sin({DAYMIN} * (2 * pi() / 1440)), 9) + 0.0 AS day_sin, round(cos({DAYMIN} * (2 * pi() / 1440)), 9) + 0.0 AS day_cos,
           round(sin(radians(heading)), 9) + 0.0 AS heading_sin, round(cos(radians(heading)), 9) + 0.0 AS heading_cos FROM pings""")
def _(t):
    s, c = S.cyclical(T.minutes_since_midnight("ts_ms"), 1440)
    h = F.radians("heading")
    return t.pings.select("event_id", near(s, 9).alias("day_sin"), near(c, 9).alias("day_cos"), near(F.sin(h), 9).alias("heading_sin"), near(F.cos(h), 9).alias("heading_cos"))


@query("f5_is_rush_hour", f"""
    SELECT event_id, CASE WHEN {HOUR} IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END AS by_hour,
           CASE WHEN ({HOUR} >= 7 AND {HOUR} < 9) OR ({HOUR} >= 16 AND {HOUR} < 18) THEN 1 ELSE 0 END AS half_open,
           CASE WHEN {DAYMIN} BETWEEN 420 AND 540 OR {DAYMIN} BETWEEN 960 AND 1080 THEN 1 ELSE 0 END AS by_minutes FROM pings""")
def _(t):
    return t.pings.select("event_id", S.rush_by_hour("ts_ms").cast("int").alias("by_hour"), S.rush_half_open("ts_ms").cast("int").alias("half_open"), S.rush_by_minutes("ts_ms").cast("int").alias("by_minutes"))


@query("f6_is_class_change", f"""
    SELECT event_id, CASE WHEN len(list_filter([480, 530, 590, 640, 700, 750, 810, 860, 920, 970], lambda x: abs({DAYMIN} - x) <= 10)) > 0 THEN 1 ELSE 0 END AS listed,
           CASE WHEN {MINUTE} >= 50 OR {MINUTE} <= 10 THEN 1 ELSE 0 END AS hourly FROM pings""")
def _(t):
    return t.pings.select("event_id", S.class_change_listed("ts_ms").cast("int").alias("listed"), S.class_change_hourly("ts_ms").cast("int").alias("hourly"))


@query("f7_minutes_since_last_stop", """
    SELECT event_id, CASE WHEN ts_ms - last_stop_time_ms > 0 AND ts_ms - last_stop_time_ms < 3600000 THEN round((ts_ms - last_stop_time_ms) / 60000, 6) ELSE 0 END AS minutes FROM pings""")
def _(t):
    return t.pings.select("event_id", near(S.minutes_since_last_stop("ts_ms", "last_stop_time_ms")).alias("minutes"))


ETA_LEFT = "((coalesce(eta_minutes, 0) - ((ts_ms - 21600000) % 86400000) / 60000) * 60)"


@query("f8_minutes_of_day_to_eta", f"""
    SELECT event_id, round(CASE WHEN coalesce(eta_minutes, 0) > 0 AND {ETA_LEFT} > 0 THEN {ETA_LEFT} ELSE -1 END, 5) AS eta_s,
           CASE WHEN coalesce(eta_minutes, 0) > 0 AND {ETA_LEFT} > 0 THEN 1 ELSE 0 END AS has_eta_s FROM pings""")
def _(t):
    return rounded(quality.eta_seconds_with_flag(t.pings, "eta_minutes", "ts_ms", "eta_s").select("event_id", "eta_s", "has_eta_s"), 5)


@query("f9_dictionary_encode", "SELECT event_id, vehicle_name, dense_rank() OVER (ORDER BY vehicle_name) - 1 AS idx FROM pings")
def _(t):
    return features.dictionary_encode(t.pings, "vehicle_name", "idx").select("event_id", "vehicle_name", "idx")


@query("f9_first_seen_encode", """
    WITH f AS (SELECT kind, row_number() OVER (ORDER BY min(ts_ms * 1000000 + event_id), kind) - 1 AS idx FROM pings GROUP BY kind)
    SELECT event_id, kind, idx FROM pings JOIN f USING (kind)""")
def _(t):
    return features.first_seen_encode(t.pings, "kind", ["ts_ms", "event_id"], "idx").select("event_id", "kind", "idx")


@query("f10_one_hot_weekday", "SELECT event_id, " + ", ".join(f"CASE WHEN {DOW} = {d} THEN 1 ELSE 0 END AS dow_{d}" for d in range(7)) + " FROM pings")
def _(t):
    return t.pings.withColumn("d", T.weekday("ts_ms")).select("event_id", *[c.alias(n) for n, c in S.weekday_flags("d").items()])


@query("f11_zscore", """
    WITH s AS (SELECT avg(speed) AS m, stddev_pop(speed) AS d, avg(heading) AS hm, stddev_pop(heading) AS hd FROM pings WHERE ts_ms < 1705276800000)
    SELECT event_id, round((speed - m) / d, 6) + 0.0 AS speed_z, round((heading - hm) / hd, 6) + 0.0 AS heading_z FROM pings, s""")
def _(t):
    fit = features.zscore_fit(t.pings.where("ts_ms < 1705276800000"), ["speed", "heading"])
    return rounded(features.zscore_apply(t.pings, fit, ["speed", "heading"]).select("event_id", "speed_z", "heading_z"))


@query("f11_zscore_per_route", """
    WITH s AS (SELECT route_id, avg(speed) AS m, CASE WHEN stddev_pop(speed) < 1e-6 THEN 1 ELSE stddev_pop(speed) END AS d FROM pings GROUP BY route_id)
    SELECT event_id, round((speed - m) / d, 6) + 0.0 AS speed_z FROM pings JOIN s USING (route_id)""")
def _(t):
    fit = features.zscore_fit(t.pings, ["speed"], ["route_id"])
    return rounded(features.zscore_apply(t.pings, fit, ["speed"], ["route_id"]).select("event_id", "speed_z"))


@query("f12_log_label", "SELECT event_id, round(ln(1 + speed), 9) AS log_s, round(exp(ln(1 + speed)) - 1, 6) AS back_s FROM pings")
def _(t):
    return t.pings.select("event_id", near(S.log_label("speed"), 9).alias("log_s"), near(S.unlog_label(S.log_label("speed"))).alias("back_s"))


@query("f13_clip", "SELECT event_id, CASE WHEN eta_minutes IS NULL THEN NULL ELSE least(greatest(eta_minutes, 100), 1000) END AS clipped, greatest(speed, 5) AS low_only FROM pings")
def _(t):
    return t.pings.select("event_id", S.clip("eta_minutes", 100.0, 1000.0).alias("clipped"), S.clip("speed", low=5.0).alias("low_only"))


@query("f14_format_eta", "SELECT event_id, CASE WHEN speed * 10 < 60 THEN '< 1 min' ELSE CAST(floor(speed * 10 / 60 + 0.5) AS BIGINT) || ' min' END AS txt FROM pings")
def _(t):
    return t.pings.select("event_id", S.eta_text(F.col("speed") * 10).alias("txt"))


@query("f15_delay_flags", "SELECT event_id, CASE WHEN d <= 0 THEN 1 ELSE 0 END AS on_time, CASE WHEN d > 300 THEN 1 ELSE 0 END AS is_delayed FROM (SELECT event_id, (event_id % 700) - 200 AS d FROM pings)")
def _(t):
    return t.pings.select("event_id", *[c.alias(n) for n, c in S.delay_flags(F.col("event_id") % 700 - 200).items()])


@query("f16_load_ratio", "SELECT event_id, round(least(passenger_load / 50, 1.0), 6) AS ratio FROM pings")
def _(t):
    return t.pings.select("event_id", near(S.load_ratio("passenger_load")).alias("ratio"))


@query("f17_scheduled_from_stop_list", f"""
    WITH s AS (SELECT event_id, {DAYMIN} AS now, next_stop_id AS target,
                      [{{'id': last_stop_id, 'minutes': (event_id * 3) % 1440}}, {{'id': (last_stop_id + event_id % 3) % 12, 'minutes': (event_id * 5) % 1440}}] AS l FROM pings)
    SELECT event_id, coalesce(greatest((list_filter(l, lambda x: x.id = target)[1].minutes - now) * 60, 0), 0)::DOUBLE AS sched_s FROM s""")
def _(t):
    e = F.col("event_id")
    stops = F.array(
        F.struct(F.col("last_stop_id").alias("id"), ((e * 3) % 1440).alias("minutes")),
        F.struct(((F.col("last_stop_id") + e % 3) % 12).alias("id"), ((e * 5) % 1440).alias("minutes")))
    return t.pings.withColumn("stops", stops).select("event_id", S.scheduled_from_stop_list("stops", "next_stop_id", T.minutes_since_midnight("ts_ms")).alias("sched_s"))


@query("f18_heading_change", "SELECT event_id, least(abs(heading - o), 360 - abs(heading - o)) AS turn FROM (SELECT event_id, heading, ((event_id * 53) % 360)::DOUBLE AS o FROM pings)")
def _(t):
    return t.pings.select("event_id", S.heading_change("heading", ((F.col("event_id") * 53) % 360).cast("double")).alias("turn"))


@query("f19_bucketize", """
    SELECT time_bucket, stop_bucket, dist_bucket, label_bucket, day_part, count(*) AS n FROM (
      SELECT CASE WHEN actual < 60 THEN '0-1min' WHEN actual < 120 THEN '1-2min' WHEN actual < 300 THEN '2-5min' WHEN actual < 600 THEN '5-10min' WHEN actual < 1200 THEN '10-20min' ELSE '20min+' END AS time_bucket,
             CASE WHEN stops_away <= 1 THEN '1' WHEN stops_away <= 3 THEN '2-3' WHEN stops_away <= 6 THEN '4-6' ELSE '7+' END AS stop_bucket,
             CASE WHEN distance_m < 1000 THEN '<1km' WHEN distance_m < 3000 THEN '1-3km' WHEN distance_m < 5000 THEN '3-5km' ELSE '5km+' END AS dist_bucket,
             CASE WHEN actual < 60 THEN '0-60s' WHEN actual < 300 THEN '60-300s' WHEN actual < 600 THEN '300-600s' WHEN actual < 1800 THEN '600-1800s' ELSE '1800s+' END AS label_bucket,
             CASE WHEN hour < 6 THEN 'evening' WHEN hour < 11 THEN 'morning' WHEN hour < 14 THEN 'midday' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS day_part
      FROM predictions) GROUP BY ALL""")
def _(t):
    return t.predictions.groupBy(
        S.bucketize("actual", *S.TIME_BUCKETS).alias("time_bucket"), S.stops_bucket("stops_away").alias("stop_bucket"),
        S.bucketize("distance_m", *S.DISTANCE_BUCKETS).alias("dist_bucket"), S.bucketize("actual", *S.LABEL_BUCKETS).alias("label_bucket"),
        S.time_of_day("hour").alias("day_part")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_quantile_bins", """
    WITH v AS (SELECT *, (ts_ms - last_stop_time_ms) / 1000 AS s FROM pings),
         q AS (SELECT list_distinct(quantile_cont(s, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM v WHERE s >= 0),
         e AS (SELECT list_concat([0.0::DOUBLE], list_sort(e)[2:-2], ['Infinity'::DOUBLE]) AS e FROM q)
    SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN -1 ELSE greatest(least(len(list_filter(e, lambda x: x < s)), len(e) - 1), 1) - 1 END::INTEGER AS decile FROM v, e""")
def _(t):
    edges = tiers.quantile_bins_fit(t.pings, tiers.elapsed_seconds())
    return tiers.quantile_bins_apply(t.pings, tiers.elapsed_seconds(), edges, "decile").select("event_id", "decile")


SEGMENT = """
    greatest(least(CASE WHEN last_stop_progress IS NULL THEN floor((target_stop_progress - progress) * 10)
      ELSE floor((CASE WHEN target_stop_progress - progress < 0 THEN target_stop_progress - progress + 1 ELSE target_stop_progress - progress END)
        / (CASE WHEN target_stop_progress - last_stop_progress <= 0 THEN target_stop_progress - last_stop_progress + 1 ELSE target_stop_progress - last_stop_progress END) * 10) END, 9), 0)::INTEGER"""


@query("f21_segment_decile", f"SELECT event_id, target_stop_id, {SEGMENT} AS decile FROM labeled")
def _(t):
    return t.labeled.select("event_id", "target_stop_id", S.segment_decile("progress", "target_stop_progress", "last_stop_progress").alias("decile"))


@query("f22_stopped_and_on_time_bins", """
    SELECT event_id, CASE WHEN passenger_load = 0 THEN 1 ELSE 0 END AS stopped,
           CASE WHEN last_stop_on_time IS NULL THEN -1 WHEN last_stop_on_time < 0 THEN 0 WHEN last_stop_on_time <= 1 THEN 1 WHEN last_stop_on_time <= 5 THEN 2 ELSE 3 END AS bin4,
           CASE WHEN last_stop_on_time IS NULL THEN -1 WHEN last_stop_on_time < 0 THEN 0 WHEN last_stop_on_time <= 4 THEN 1 ELSE 2 END AS bin3 FROM pings""")
def _(t):
    return t.pings.select("event_id", S.is_stopped("passenger_load").alias("stopped"), S.on_time_bin("last_stop_on_time").alias("bin4"), S.on_time_bin3("last_stop_on_time").alias("bin3"))


@query("f23_game_day_features", """
    WITH g AS (SELECT arrival_ms // 86400000 AS day, min(arrival_ms) AS kick FROM arrivals WHERE dwell_s > 150 GROUP BY 1)
    SELECT event_id, CASE WHEN kick IS NULL THEN 0 ELSE 1 END AS is_game_day, round(coalesce((kick - ts_ms) / 3600000, 0), 7) + 0.0 AS hours_to_kickoff
    FROM pings LEFT JOIN g ON day = ts_ms // 86400000""")
def _(t):
    games = t.arrivals.where("dwell_s > 150").select(F.col("arrival_ms").alias("kickoff_ms"))
    return rounded(features.game_day_features(t.pings, games).select("event_id", "is_game_day", "hours_to_kickoff"), 7)


@query("f24_predicted_dwell", "SELECT event_id, round((speed + heading + passenger_load) * 3, 6) AS dwell FROM pings")
def _(t):
    rates = F.array("speed", "heading", F.col("passenger_load").cast("double"), "progress")
    return t.pings.select("event_id", near(S.predicted_dwell(rates)).alias("dwell"))


@query("f25_base_features", f"""
    WITH m AS (SELECT median(temperature_c) AS tm FROM weather), len AS (SELECT route_id, max(max_dist) AS l FROM stop_seq GROUP BY route_id)
    SELECT a.event_id, a.target_stop_id, round(greatest((target_stop_progress - progress) * l, 0), 6) + 0.0 AS distance_to_target,
           CASE WHEN eta_minutes IS NOT NULL THEN greatest(eta_minutes, 0) END AS scheduled_time_to_target, speed AS current_speed, a.stops_away AS stops_remaining, target_stop_sequence AS stop_index,
           {DAYMIN}::INTEGER AS minutes_since_midnight, {DOW}::INTEGER AS day_of_week,
           coalesce(precipitation_mm, 0) AS precipitation_mm, coalesce(temperature_c, tm) AS temperature_c, CASE WHEN speed <= 2 THEN 1 ELSE 0 END AS is_idle
    FROM ahead a JOIN len USING (route_id) CROSS JOIN m LEFT JOIN weather w ON w.hour_ms = a.ts_ms // 3600000 * 3600000""")
def _(t):
    from pingloom.operators.quantiles import grouped_quantiles

    median = grouped_quantiles(t.weather, [], "temperature_c", {"m": 0.5}).select("m").scalar()
    rows = features.base_features(t.ahead, t.stop_seq, t.weather, median, "eta_minutes")
    return rounded(rows.select(
        "event_id", "target_stop_id", "distance_to_target", "scheduled_time_to_target", "current_speed", "stops_remaining", "stop_index",
        "minutes_since_midnight", "day_of_week", "precipitation_mm", "temperature_c", "is_idle"))
