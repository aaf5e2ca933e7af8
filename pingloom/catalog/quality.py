"""Data-quality reports (Q*)."""

from pyspark.sql import functions as F

from pingloom.catalog.events import VEH_W
from pingloom.catalog.registry import query, rounded
from pingloom.catalog.scalars import DAYMIN, HOUR
from pingloom.functions import scalars as S
from pingloom.functions.times import hour_of
from pingloom.operators import events, quality, windows

COLS = ["event_id", "last_stop_time_ms", "last_stop_on_time", "eta_minutes", "speed"]


@query("q1_null_rates", "WITH n AS (SELECT count(*) AS n FROM pings) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS n_null, round(count_if({c} IS NULL) / any_value(n) * 100, 6) AS null_pct FROM pings, n" for c in COLS)
    + " UNION ALL SELECT '*', count_if(" + " OR ".join(f"{c} IS NULL" for c in COLS) + ")::BIGINT, round(count_if(" + " OR ".join(f"{c} IS NULL" for c in COLS) + ") / any_value(n) * 100, 6) FROM pings, n")
def _(t):
    return rounded(quality.null_rates(t.pings.select(*COLS)))


@query("q2_range_checks", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count_if({c} < {lo} OR {c} > {hi})::BIGINT AS n_outside, round(count_if({c} < {lo} OR {c} > {hi}) / count(*) * 100, 6) AS outside_pct FROM pings"
    for c, lo, hi in (("speed", 0, 80), ("lat", 32.5, 32.7), ("lon", -85.6, -85.4), ("progress", -1, 1))))
def _(t):
    return rounded(quality.range_checks(t.pings))


@query("q3_rolling_consistency", """
    WITH x AS (SELECT speed, heading, coalesce(stddev_samp(speed) OVER a, 0) AS s1, coalesce(stddev_samp(speed) OVER b, 0) AS s2, avg(speed) OVER a AS m FROM pings
               WINDOW a AS (PARTITION BY vehicle_id ORDER BY ts_ms RANGE BETWEEN 43199999 PRECEDING AND CURRENT ROW), b AS (PARTITION BY vehicle_id ORDER BY ts_ms RANGE BETWEEN 259199999 PRECEDING AND CURRENT ROW))
    SELECT round(avg(s1), 5) AS short_std_mean, round(avg(s2), 5) AS long_std_mean, round(avg(abs(m - speed)), 5) AS avg_vs_instant, CASE WHEN avg(s1) >= avg(s2) THEN 1 ELSE 0 END AS shorter_more_variable FROM x""")
def _(t):
    rolled = windows.rolling_stats(t.pings, [43200, 259200])
    out = quality.rolling_consistency(rolled, "speed_std_43200s", "speed_std_259200s", "speed_avg_43200s", "speed", "distance_traveled_43200s", "heading_change_259200s")
    return rounded(out.select("short_std_mean", "long_std_mean", "avg_vs_instant", "shorter_more_variable"), 5)


@query("q4_label_quality", """
    SELECT count(x) AS n_labels, count_if(x IS NULL)::BIGINT AS n_missing, round(count_if(x IS NULL) / count(*) * 100, 6) AS missing_pct, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
           count_if(x < 0)::BIGINT AS n_negative, count_if(x > 3600)::BIGINT AS n_over_1h, count_if(x > 1800)::BIGINT AS n_over_30min, count_if(x >= 0 AND x < 60)::BIGINT AS n_0_60, count_if(x >= 60 AND x < 300)::BIGINT AS n_60_300,
           count_if(x >= 300 AND x < 600)::BIGINT AS n_300_600, count_if(x >= 600 AND x < 1800)::BIGINT AS n_600_1800, count_if(x >= 1800 AND x <= 3600)::BIGINT AS n_1800_3600, round(median(x), 6) AS median
    FROM (SELECT schedule_eta * 40 AS x FROM predictions)""")
def _(t):
    return rounded(quality.label_quality(t.predictions.select((F.col("schedule_eta") * 40).alias("x")), "x"))


JQ = "round(count(schedule_eta) / count(*) * 100, 6) AS match_pct, CASE WHEN count(schedule_eta) < 100 THEN 1 ELSE 0 END AS few_samples"


@query("q5_join_quality", f"""
    SELECT 'overall' AS dimension, 'all' AS value, count(*) AS n, count(schedule_eta) AS n_labeled, {JQ} FROM predictions
    UNION ALL SELECT 'supp_id', CAST(supp_id AS VARCHAR), count(*), count(schedule_eta), {JQ} FROM predictions GROUP BY supp_id
    UNION ALL SELECT 'stops_away', CAST(stops_away AS VARCHAR), count(*), count(schedule_eta), {JQ} FROM predictions GROUP BY stops_away""")
def _(t):
    return rounded(quality.join_quality(t.predictions, "schedule_eta", ["supp_id", "stops_away"]))


@query("q6_weather_coverage", """
    WITH h AS (SELECT unnest(range((SELECT min(ts_ms) // 3600000 FROM pings), (SELECT max(ts_ms) // 3600000 + 1 FROM pings))) AS h) SELECT h * 3600000 AS missing_hour_ms FROM h WHERE h * 3600000 NOT IN (SELECT hour_ms FROM weather)""")
def _(t):
    span = t.pings.agg(F.struct(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).alias("s")).scalar()
    return quality.weather_coverage(t.weather, "hour_ms", span["a"], span["b"])


@query("q8_spike_check", """
    SELECT count(x) AS n, count_if(x BETWEEN 3540 AND 3660)::BIGINT AS n_spike, count_if(x > 3500 AND x <= 3600)::BIGINT AS n_cutoff, round(count_if(x BETWEEN 3540 AND 3660) / count(x) * 100, 6) AS spike_pct,
           CASE WHEN count_if(x BETWEEN 3540 AND 3660) / count(x) * 100 > 5 THEN 1 ELSE 0 END AS suspicious FROM (SELECT actual * 3 AS x FROM predictions)""")
def _(t):
    return rounded(quality.spike_check(t.predictions.select((F.col("actual") * 3).alias("x")), "x"))


SUITE = f"""
    WITH p AS (SELECT vehicle_id, nullif(last_stop_id, 0) AS stop_id, eta_minutes AS scheduled_s, (event_id % 4000 - 50)::DOUBLE AS label_s, {HOUR} AS hour,
                      CASE WHEN {DAYMIN} % 60 >= 50 THEN 1 ELSE 0 END AS is_class_change, heading * 6 AS heading_change, speed AS route_distance, last_stop_on_time AS speed_mean,
                      heading AS haversine, progress * 10 - 5 AS minutes_since_stop, w.temperature_c, w.precipitation_mm, (speed - heading) / 10000 AS acceleration
               FROM pings LEFT JOIN (SELECT hour_ms, 20.0::DOUBLE AS temperature_c, floor(precipitation_mm) AS precipitation_mm FROM weather) w ON w.hour_ms = ts_ms // 3600000 * 3600000),
         n AS (SELECT count(*) AS n, count_if(route_distance = 0 AND haversine > 0) AS hz, count_if(minutes_since_stop = 0) AS ms, count_if(temperature_c = 20.0 AND precipitation_mm = 0.0) AS wf, max(abs(acceleration)) AS acc, count_if(heading_change > 1800) AS a, count_if(speed_mean IS NULL) AS b, count_if((hour < 6 OR hour > 22) AND is_class_change = 1) AS c, count_if(scheduled_s <= 0) AS d, count_if(label_s < 0) AS e,
                      count_if(label_s > 3600) AS f, count_if(label_s = 0) AS g, count_if(stop_id IS NULL) AS h, count_if(label_s > 3500 AND label_s <= 3600) AS i, count(DISTINCT vehicle_id) AS v,
                      count_if(route_distance > 20000) AS j, count_if(route_distance = 0) AS k, count_if(stop_id IS NULL) + count_if(scheduled_s IS NULL) + count_if(speed_mean IS NULL) + count_if(temperature_c IS NULL) + count_if(precipitation_mm IS NULL) + count_if(haversine IS NULL) + count_if(minutes_since_stop IS NULL) + count_if(acceleration IS NULL) AS holes FROM p)
    SELECT 'Features' AS category, 'Heading Change Unbounded' AS "check", a::BIGINT AS affected, n AS total, CASE WHEN a > 0 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM n
    UNION ALL SELECT 'Distance', 'Haversine Fallback Zeros', hz::BIGINT, n, CASE WHEN hz > 0 THEN 'CRITICAL' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Temporal', 'Minutes Since Stop Capped', ms::BIGINT, n, CASE WHEN ms > n * 0.1 THEN 'LOW' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Data Quality', 'Weather FillNA Ambiguity', wf::BIGINT, n, CASE WHEN wf > n * 0.1 THEN 'LOW' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Features', 'Acceleration Magnitude', CASE WHEN acc < 0.1 THEN n ELSE 0 END, n, CASE WHEN acc < 0.1 THEN 'LOW' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Distance', 'Circular Route Wraparound', j::BIGINT, n, CASE WHEN j > 0 THEN 'HIGH' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Distance', 'Missing GTFS Trip Data', k::BIGINT, n, CASE WHEN k > n * 0.1 THEN 'HIGH' WHEN k > 0 THEN 'MEDIUM' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Features', 'Rolling Feature NaN', b::BIGINT, n, CASE WHEN b > n * 0.05 THEN 'MEDIUM' WHEN b > 0 THEN 'LOW' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Temporal', 'Class Change Midnight Wraparound', c::BIGINT, n, CASE WHEN c > 0 THEN 'MEDIUM' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Temporal', 'Scheduled Time Next-Day', d::BIGINT, n, CASE WHEN d > n * 0.05 THEN 'HIGH' WHEN d > 0 THEN 'MEDIUM' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Labels', 'Negative ETA Values', e::BIGINT, n, CASE WHEN e > 0 THEN 'CRITICAL' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Labels', 'Label Outliers', f::BIGINT, n, CASE WHEN f > n * 0.01 THEN 'MEDIUM' WHEN f > 0 THEN 'LOW' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Labels', 'Join Success Rate', g::BIGINT, n, CASE WHEN g > n * 0.5 THEN 'HIGH' WHEN g > n * 0.2 THEN 'MEDIUM' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Labels', '1-Hour Lookahead Bias', i::BIGINT, n, CASE WHEN i > 100 THEN 'HIGH' WHEN i > 0 THEN 'MEDIUM' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Data Quality', 'Stop Mapping Failures', h::BIGINT, n, CASE WHEN h > n * 0.05 THEN 'MEDIUM' WHEN h > 0 THEN 'LOW' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Data Quality', 'Vehicle ID Mismatches', CASE WHEN v > 50 THEN v ELSE 0 END, v, CASE WHEN v > 50 THEN 'HIGH' ELSE 'INFO' END FROM n
    UNION ALL SELECT 'Data Quality', 'Feature Completeness', holes::BIGINT, n * 14, CASE WHEN holes > n * 14 * 0.05 THEN 'MEDIUM' WHEN holes > 0 THEN 'LOW' ELSE 'INFO' END FROM n"""


def suite_rows(t):
    """Every column a check asks for."""
    e = F.col("event_id")
    hourly = t.weather.select(F.col("hour_ms").alias("_hour"), F.lit(20.0).alias("temperature_c"), F.floor("precipitation_mm").cast("double").alias("precipitation_mm"))
    return t.pings.join(hourly, F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000 == F.col("_hour"), "left").select(
        "vehicle_id", F.nullif("last_stop_id", F.lit(0)).alias("stop_id"), F.col("eta_minutes").alias("scheduled_s"), (e % 4000 - 50).cast("double").alias("label_s"),
        hour_of("ts_ms").alias("hour"), (F.pmod(F.floor(F.col("ts_ms") / 60000), F.lit(60)) >= 50).cast("int").alias("is_class_change"),
        (F.col("heading") * 6).alias("heading_change"), F.col("speed").alias("route_distance"), F.col("last_stop_on_time").alias("speed_mean"),
        F.col("heading").alias("haversine"), (F.col("progress") * 10 - 5).alias("minutes_since_stop"), "temperature_c", "precipitation_mm", ((F.col("speed") - F.col("heading")) / 10000).alias("acceleration"))


@query("q9_validation_suite", SUITE)
def _(t):
    return quality.validation_suite(suite_rows(t))


@query("q9_severity_summary", f"WITH s AS ({SUITE.strip().replace('WITH p AS', 'WITH p AS', 1)}) SELECT category, " + ", ".join(f"count_if(severity = '{s}')::BIGINT AS \"{s}\"" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) + " FROM s GROUP BY category")
def _(t):
    return quality.severity_summary(quality.validation_suite(suite_rows(t)))


ISSUES = f"""
    l AS (SELECT *, lag(next_stop_id) OVER w AS ps, lag(eta_minutes) OVER w AS pe, lag(ts_ms) OVER w AS pt, lag(speed) OVER w AS pv FROM pings WINDOW w AS {VEH_W}),
    m AS (SELECT l.*, CASE WHEN a.arrival_ms - l.pt <= 259200000 THEN a.arrival_ms END AS hit, (eta_minutes - ((ts_ms - 21600000) % 86400000) / 60000) * 60 AS es
          FROM l ASOF LEFT JOIN arrivals a ON a.vehicle_id = l.vehicle_id AND a.stop_id = l.ps AND l.pt < a.arrival_ms),
    f AS (SELECT event_id, ts_ms, CASE WHEN eta_minutes > 0 AND es < 0 THEN 1 ELSE 0 END AS negative_eta, CASE WHEN ps = next_stop_id AND abs(eta_minutes - pe) * 60 > (ts_ms - pt) / 1000 + 120 THEN 1 ELSE 0 END AS large_eta_jump,
                 CASE WHEN ps <> next_stop_id AND ts_ms < hit THEN 1 ELSE 0 END AS stop_transition_mismatch, CASE WHEN speed = 0 AND pv = 0 AND ts_ms - pt > 30000 THEN 1 ELSE 0 END AS stale_position,
                 CASE WHEN ps = next_stop_id AND ts_ms > hit THEN 1 ELSE 0 END AS eta_after_arrival, CASE WHEN es > 1800 THEN 1 ELSE 0 END AS impossible_eta FROM m)"""


def issue_flags(t):
    return quality.telemetry_issue_flags(t.pings, t.arrivals, reach_ms=259_200_000)


@query("q10_telemetry_issues", f"WITH {ISSUES} SELECT count(*) AS total_records, " + ", ".join(f"sum({i})::BIGINT AS {i}" for i in quality.ISSUES) + ", count_if(" + " + ".join(quality.ISSUES) + " = 0)::BIGINT AS valid_records, round(count_if(" + " + ".join(quality.ISSUES) + " = 0) / count(*) * 100, 6) AS valid_pct FROM f")
def _(t):
    return rounded(quality.telemetry_issues(issue_flags(t)))


@query("q10_issue_examples", f"WITH {ISSUES}, u AS (" + " UNION ALL ".join(f"SELECT '{i}' AS issue, event_id, ts_ms FROM f WHERE {i} = 1" for i in quality.ISSUES) + "), k AS (SELECT issue, row_number() OVER (PARTITION BY issue ORDER BY ts_ms, event_id)::INTEGER AS rank, event_id, ts_ms FROM u) SELECT * FROM k WHERE rank <= 3")
def _(t):
    return quality.issue_examples(issue_flags(t))


@query("q11_mismatch_cases", f"""
    WITH tr AS (SELECT event_id, vehicle_id, ts_ms, ps AS stop_id, pt FROM (SELECT *, lag(next_stop_id) OVER w AS ps, lag(ts_ms) OVER w AS pt FROM pings WINDOW w AS {VEH_W}) WHERE ps <> next_stop_id AND ps <> 0),
         x AS (SELECT tr.*, CASE WHEN a.arrival_ms - pt <= 864000000 THEN a.arrival_ms END AS next_ms FROM tr ASOF LEFT JOIN arrivals a ON a.vehicle_id = tr.vehicle_id AND a.stop_id = tr.stop_id AND tr.pt < a.arrival_ms),
         y AS (SELECT tr.event_id, arg_min(a.arrival_ms, abs(a.arrival_ms - tr.ts_ms) * 10 + CASE WHEN a.arrival_ms > tr.ts_ms THEN 1 ELSE 0 END) AS near_ms FROM tr JOIN arrivals a ON a.vehicle_id = tr.vehicle_id AND a.stop_id = tr.stop_id
               AND a.arrival_ms BETWEEN tr.ts_ms - 259200000 AND tr.ts_ms + 432000000 GROUP BY tr.event_id)
    SELECT x.event_id, next_ms, near_ms FROM x LEFT JOIN y USING (event_id) WHERE next_ms IS DISTINCT FROM near_ms""")
def _(t):
    marks = events.stop_transitions(t.pings, "next_stop_id", ["vehicle_id"]).where("prev_value <> 0").select("event_id", "vehicle_id", "ts_ms", F.col("prev_value").alias("stop_id"), "prev_ts_ms")
    out = quality.mismatch_cases(marks, t.arrivals, ["vehicle_id"], 864_000_000, 259_200_000, 432_000_000)
    return out.select("event_id", "next_ms", "near_ms")


@query("q12_status_profile", """
    WITH c AS (SELECT status, vehicle_name, count(*) AS n FROM pings GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY vehicle_name) AS r FROM c)
    SELECT status, sum(n)::BIGINT AS n, string_agg(vehicle_name, ',' ORDER BY vehicle_name) FILTER (r <= 3) AS examples FROM d GROUP BY status""")
def _(t):
    return quality.status_profile(t.pings).withColumn("examples", F.array_join("examples", ","))


@query("q12_clock_lag", "SELECT round(avg((ts_ms - last_stop_time_ms) / 1000), 6) AS mean_lag_s, min((ts_ms - last_stop_time_ms) / 1000) AS min_lag_s, max((ts_ms - last_stop_time_ms) / 1000) AS max_lag_s, count(last_stop_time_ms) AS n FROM pings")
def _(t):
    return rounded(quality.clock_lag(t.pings, "ts_ms", "last_stop_time_ms"))


@query("q12_eta_unit_test", """
    WITH s AS (SELECT (event_id % 4)::VARCHAR AS psid, eta_minutes AS seta, [{'psid': '0', 'time': eta_minutes}, {'psid': '1', 'time': speed}, {'psid': (event_id % 3)::VARCHAR, 'time': 7.0}] AS l FROM pings),
         h AS (SELECT seta, list_filter(l, lambda x: x.psid = psid)[1].time AS tm FROM s)
    SELECT count_if(tm = seta)::BIGINT AS matches, count_if(tm <> seta)::BIGINT AS mismatches FROM h""")
def _(t):
    e = F.col("event_id")
    item = lambda p, x: F.struct(p.alias("psid"), x.alias("time"))
    stops = F.array(item(F.lit("0"), F.col("eta_minutes")), item(F.lit("1"), F.col("speed")), item((e % 3).cast("string"), F.lit(7.0)))
    rows = t.pings.select((e % 4).cast("string").alias("psid"), F.col("eta_minutes").alias("seta"), stops.alias("stops"))
    return quality.eta_unit_test(rows, "stops", "psid", "seta")


@query("q13_violations", """
    SELECT 'speed_not_negative' AS rule, count_if(NOT speed >= 0)::BIGINT AS n_violations FROM pings UNION ALL SELECT 'progress_in_unit', count_if(NOT progress BETWEEN 0 AND 1)::BIGINT FROM pings
    UNION ALL SELECT 'eta_known', count_if(eta_minutes IS NULL)::BIGINT FROM pings""")
def _(t):
    rules = {"speed_not_negative": F.col("speed") >= 0, "progress_in_unit": F.col("progress").between(0, 1), "eta_known": F.col("eta_minutes") >= 0}
    return quality.violations(t.pings, rules)


EXPECTED = ("vehicle_id", "route_id", "speed", "heading", "dwell_median", "elapsed_decile")


@query("q14_quality_report", """
    WITH v AS (SELECT 'label_missing_rate' AS name, count_if(eta_minutes IS NULL OR event_id % 2 = 0) / count(*) * 100 AS value FROM pings UNION ALL SELECT 'speed_out_of_range_rate', count_if(speed < 0 OR speed > 80) / count(*) * 100 FROM pings
               UNION ALL SELECT 'mean_speed', avg(speed) FROM pings UNION ALL SELECT 'labels_negative', count_if(event_id % 4000 < 50)::DOUBLE FROM pings UNION ALL SELECT 'missing_expected_features', 2.0::DOUBLE),
    w AS (SELECT *, CASE name WHEN 'label_missing_rate' THEN 30.0::DOUBLE WHEN 'speed_out_of_range_rate' THEN 1.0::DOUBLE WHEN 'labels_negative' THEN 0.0::DOUBLE WHEN 'missing_expected_features' THEN 0.0::DOUBLE END AS t FROM v)
    SELECT name, round(value, 6) AS value, t AS threshold, CASE WHEN t IS NULL OR value <= t THEN 1 ELSE 0 END AS ok,
           CASE WHEN value > t THEN CASE name WHEN 'missing_expected_features' THEN 'missing expected features: dwell_median, elapsed_decile' WHEN 'labels_negative' THEN value::BIGINT || ' negative labels found'
                ELSE printf('%s of %.3f%% exceeds the threshold of %.1f%%', name, value, t) END END AS warning FROM w""")
def _(t):
    e = F.col("event_id")
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int")) * 100
    row = t.pings.agg(rate(F.col("eta_minutes").isNull() | (e % 2 == 0)).alias("label_missing_rate"), rate((F.col("speed") < 0) | (F.col("speed") > 80)).alias("speed_out_of_range_rate"), F.avg("speed").alias("mean_speed"),
                      F.count_if(e % 4000 < 50).cast("double").alias("labels_negative"))
    return rounded(quality.quality_report(row.unpivot([], row.columns, "name", "value"), EXPECTED, t.pings.columns))


@query("f6_class_change_rates", f"SELECT {HOUR}::INTEGER AS hour, count(*) AS n, count_if({DAYMIN} % 60 >= 50 OR {DAYMIN} % 60 <= 10)::BIGINT AS n_change FROM pings GROUP BY 1")
def _(t):
    return t.pings.groupBy(hour_of("ts_ms").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(S.class_change_hourly("ts_ms")).alias("n_change"))
