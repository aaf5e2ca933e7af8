"""Sources and sinks (SRC*, SNK*): files are written from the driver tables by Spark, then read back."""

import uuid

from pyspark.sql import functions as F

from pingloom import schemas
from pingloom.catalog.registry import near, query, rounded
from pingloom.functions import scalars as S
from pingloom.functions import times as T
from pingloom.session import shared_folder
from pingloom.sources import readers, writers


def folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def flat_record(nested=False):
    c = F.col
    return F.struct(
        c("ts_ms").alias("t"), c("vehicle_name").alias("vid"), "lat", "lon", "heading", "speed", c("passenger_load").alias("load"), "progress",
        c("route_id").alias("routeId"), c("pattern_id").alias("patternId"), c("last_stop_id").alias("lastStopId"), c("next_stop_id").alias("nextStopId"),
        c("eta_minutes").alias("etaSeconds"), c("last_stop_time_ms").alias("lastStopTime"), c("last_stop_on_time").alias("lastStopOnTime"))


def nested_record():
    c = F.col
    return F.struct(
        c("ts_ms").alias("ts"), c("vehicle_name").alias("did"), c("lat").alias("lt"), c("lon").alias("ln"), c("heading").alias("h"), c("speed").alias("v"), c("passenger_load").alias("load"),
        F.struct(c("route_id").alias("rID"), "status", c("pattern_id").alias("patternID"), c("progress").alias("nextStopPercentProgress")).alias("serviceState"),
        F.struct(c("last_stop_id").alias("stopID"), c("last_stop_time_ms").alias("time"), c("last_stop_on_time").alias("onTime")).alias("lastStop"),
        F.struct(c("next_stop_id").alias("stopID"), c("eta_minutes").alias("eta")).alias("eta"))


def broken_lines(t, name):
    """Telemetry as JSON lines; every 50th line is cut off, every 77th is followed by a blank one."""
    path = folder(t, name)
    line = F.to_json(flat_record())
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 25)).otherwise(line)
    t.pings.select(F.explode(F.when(F.col("event_id") % 77 == 0, F.array(cut, F.lit(""))).otherwise(F.array(cut))).alias("value")).write.text(path)
    return path


@query("src1_read_telemetry", "SELECT vehicle_name AS vehicle_id, ts_ms, speed, route_id, last_stop_on_time FROM pings WHERE event_id % 50 <> 0")
def _(t):
    rows, _ = readers.read_telemetry(t.spark, broken_lines(t, "telemetry"))
    return rows.select("vehicle_id", "ts_ms", "speed", "route_id", "last_stop_on_time")


@query("src1_ingest_report", "SELECT count_if(event_id % 50 <> 0)::BIGINT AS n_records, count_if(event_id % 50 = 0)::BIGINT AS n_malformed, 0 AS n_skipped FROM pings")
def _(t):
    _, report = readers.read_telemetry(t.spark, broken_lines(t, "telemetry"))
    return report.agg(F.sum("n_records").alias("n_records"), F.sum("n_malformed").alias("n_malformed"), F.sum("skipped").cast("int").alias("n_skipped"))


@query("src1_files_without_columns", "SELECT 0::BIGINT AS n_rows, 1 AS all_skipped")
def _(t):
    path = folder(t, "partial")
    t.pings.select(F.to_json(F.struct(F.col("ts_ms").alias("t"), F.col("vehicle_name").alias("vid"), "speed")).alias("value")).write.text(path)
    rows, report = readers.read_telemetry(t.spark, path)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return report.agg(n.alias("n_rows"), F.min("skipped").alias("all_skipped"))


@query("src2_normalize_telemetry", """
    SELECT ts_ms, vehicle_name AS vehicle_id, lat, lon, heading, speed, passenger_load::INTEGER AS passenger_load, route_id, pattern_id, progress, last_stop_id, next_stop_id,
           CASE WHEN event_id % 2 = 0 THEN coalesce(last_stop_time_ms, 0) ELSE last_stop_time_ms END AS last_stop_time_ms, CASE WHEN event_id % 2 = 0 THEN coalesce(eta_minutes, 0) ELSE eta_minutes END AS eta_minutes,
           CASE WHEN event_id % 2 = 0 THEN status END::BIGINT AS status FROM pings""")
def _(t):
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(nested_record())).otherwise(F.to_json(flat_record()))
    parsed = t.pings.select(F.from_json(line, schemas.TELEMETRY_ANY).alias("r")).select("r.*")
    return readers.normalize_telemetry(parsed).select(
        "ts_ms", "vehicle_id", "lat", "lon", "heading", "speed", "passenger_load", "route_id", "pattern_id", "progress", "last_stop_id", "next_stop_id", "last_stop_time_ms", "eta_minutes", "status")


def arrivals_file(t):
    path = folder(t, "arrivals")
    ms = F.col("arrival_ms") - 6 * 3_600_000
    day = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    usday = F.date_format(F.timestamp_millis(ms), "M/d/yyyy")
    clock = F.date_format(F.timestamp_millis(ms), "H:mm:ss")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat_ws(
        ",", F.when(F.col("event_id") % 2 == 0, day).otherwise(usday), quoted(F.concat(F.lit("bus "), F.col("vehicle_id").cast("string"))),
        F.when(F.col("event_id") % 13 == 0, "NIS").otherwise("12"), F.lit("Route"), quoted(F.concat(F.col("station"), F.lit(" "))), clock, clock,
        F.col("dwell_s").cast("string"), F.lit("1"), F.lit(""), F.lit("2"), F.lit("x"))
    head = F.array(F.lit("Arrivals and departures, all routes"), F.lit('"DATE","Vehicle ID",Number,Route,Station,ARRIVAL,DEPARTURE,Dwell (sec),APC Boardings,APC Alightings,EPC Boardings,EPC Alightings'))
    top = t.arrivals.agg(F.min("event_id").alias("first")).scalar()
    t.arrivals.select(F.explode(F.when(F.col("event_id") == top, F.concat(head, F.array(line))).otherwise(F.array(line))).alias("value")).write.text(path)
    return path


@query("src3_read_arrivals", "SELECT 'bus ' || vehicle_id AS vehicle, station, count(*) AS n, round(sum(dwell_s), 4) AS dwell FROM arrivals GROUP BY ALL")
def _(t):
    raw = readers.read_arrivals(t.spark, arrivals_file(t))
    return rounded(raw.groupBy(F.col("Vehicle ID").alias("vehicle"), F.col("Station").alias("station")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("Dwell (sec)").cast("double")).alias("dwell")), 4)


@query("src3_parse_arrivals", "SELECT 'bus ' || vehicle_id AS vehicle_id, station, arrival_ms // 1000 * 1000 AS arrival_ms, dwell_s, 3.0::DOUBLE AS boardings, 0.0::DOUBLE AS alightings FROM arrivals WHERE event_id % 13 <> 0")
def _(t):
    return readers.parse_arrivals(readers.read_arrivals(t.spark, arrivals_file(t))).select("vehicle_id", "station", "arrival_ms", "dwell_s", "boardings", "alightings")


@query("src4_parse_local_times", """
    WITH w AS (SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey * 977) % 108000) AS wall FROM orders),
         u AS (SELECT o_orderkey, wall, timezone('America/Chicago', wall) AS u FROM w),
         b AS (SELECT *, timezone('America/Chicago', u + INTERVAL 1 HOUR) = wall OR timezone('America/Chicago', u - INTERVAL 1 HOUR) = wall AS amb, timezone('America/Chicago', u) <> wall AS gap FROM u)
    SELECT o_orderkey, CASE WHEN amb THEN NULL WHEN gap THEN epoch_us(timezone('America/Chicago', date_trunc('hour', wall))) // 1000 ELSE epoch_us(u) // 1000 END AS utc_ms FROM b""")
def _(t):
    sec = (F.col("o_orderkey") * 977) % 108000
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return t.raw("orders").select("o_orderkey", T.local_text_to_utc_ms(day, T.seconds_to_clock(sec), "America/Chicago").alias("utc_ms"))


@query("src5_weather_hours", """
    SELECT ts_ms // 3600000 * 3600000 AS hour_ms, speed AS temperature_c, progress AS precipitation_mm, CASE WHEN progress > 0.1 THEN 1 ELSE 0 END AS is_raining FROM pings
    QUALIFY row_number() OVER (PARTITION BY ts_ms // 3600000 ORDER BY ts_ms, event_id) = 1""")
def _(t):
    return readers.weather_hours(t.pings.select("event_id", "ts_ms", "speed", "progress"), F.col("ts_ms"), "speed", "progress", ["ts_ms", "event_id"])


@query("src5_read_weather_csv", "SELECT hour_ms, temperature_c, precipitation_mm FROM weather")
def _(t):
    path = folder(t, "weather")
    t.weather.select(
        F.date_format(F.timestamp_millis("hour_ms"), "yyyy-MM-dd'T'HH:mm").alias("time"), F.col("precipitation_mm").alias("precipitation"), F.lit(0.0).alias("precipitation_probability"),
        F.col("temperature_c").alias("temperature_2m")).write.option("header", True).csv(path)
    raw = readers.read_weather_csv(t.spark, path)
    out = readers.weather_hours(raw, F.unix_millis(F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm")))
    return out.select("hour_ms", "temperature_c", "precipitation_mm")


@query("src6_read_gtfs", """
    SELECT 'routes' AS tbl, count(*) AS n, sum(route_id)::BIGINT AS checksum FROM routes UNION ALL SELECT 'stops', count(*), sum(stop_id)::BIGINT FROM stops
    UNION ALL SELECT 'trips', count(*), sum(trip_id)::BIGINT FROM trips UNION ALL SELECT 'stop_times', count(*), sum(trip_id * stop_sequence)::BIGINT FROM stop_times UNION ALL SELECT 'shapes', count(*), sum(shape_id * seq)::BIGINT FROM shapes
    UNION ALL SELECT 'calendar', count(*), sum(n_nationkey * 7)::BIGINT FROM nation UNION ALL SELECT 'lost stop_times', 0, 0""")
def _(t):
    base = folder(t, "gtfs")
    s = lambda c: F.col(c).cast("string")
    tables = {
        "routes": t.routes.select(F.concat(s("route_id"), F.lit("_7")).alias("route_id"), F.lit("R").alias("route_short_name"), F.col("long_name").alias("route_long_name"), F.lit("x").alias("agency_id")),
        "stops": t.stops.select("stop_id", "stop_name", F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon")),
        "trips": t.trips.select("trip_id", "route_id", "service_id", "shape_id"),
        "stop_times": t.stop_times.select("trip_id", F.lit("08:00:00").alias("arrival_time"), F.lit("25:10:00").alias("departure_time"), "stop_id", "stop_sequence", F.col("shape_dist").alias("shape_dist_traveled")),
        "shapes": t.shapes.select("shape_id", F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"), F.col("seq").alias("shape_pt_sequence"), F.col("dist").alias("shape_dist_traveled")),
        "calendar": t.raw("nation").select(F.col("n_nationkey").alias("service_id"), *[F.lit(1).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")], F.lit("20240101").alias("start_date"), F.lit("20241231").alias("end_date")),
    }
    for name, df in tables.items():
        df.write.option("header", True).option("quoteAll", True).csv(f"{base}/{name}.txt")
    got = readers.read_gtfs(t.spark, base)
    sums = {"routes": F.col("route_id_num"), "stops": s("stop_id").cast("long"), "trips": s("trip_id").cast("long"),
            "stop_times": s("trip_id").cast("long") * F.col("stop_sequence"), "shapes": s("shape_id").cast("long") * F.col("shape_pt_sequence"),
            "calendar": s("service_id").cast("long") * sum((F.col(d) for d in ("tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")), F.col("monday"))}
    out = None
    for name, total in sums.items():
        row = got[name].agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum(total).alias("checksum"))
        out = row if out is None else out.unionByName(row)
    lost = readers.gtfs_lost_values(t.spark, base)
    return out.unionByName(lost.agg(F.lit("lost stop_times").alias("tbl"), F.count_if(F.col("tbl") == "stop_times").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("checksum")))


@query("src7_route_id_num", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN route_id WHEN 1 THEN route_id WHEN 2 THEN NULL ELSE vehicle_id END AS num FROM pings")
def _(t):
    r, v = F.col("route_id").cast("string"), F.col("vehicle_id").cast("string")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(r, F.lit("_202_201_156"))).when(k == 1, F.concat(r, F.lit("_"))).when(k == 2, F.concat(F.lit("_"), r)).otherwise(v)
    return t.pings.select("event_id", S.route_id_num(text).alias("num"))


@query("src9_gtfs_clock", "SELECT o_orderkey, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS clock, s::INTEGER AS seconds FROM (SELECT o_orderkey, (o_orderkey * 977) % 108000 AS s FROM orders)")
def _(t):
    clock = T.seconds_to_clock((F.col("o_orderkey") * 977) % 108000)
    return t.raw("orders").select("o_orderkey", clock.alias("clock"), T.clock_to_seconds(clock).alias("seconds"))


@query("src10_unpivot_timetable", """
    WITH m AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CASE WHEN l_linenumber < 4 THEN 'north' WHEN l_linenumber < 6 THEN 'east' ELSE 'south' END AS route,
           'Stop ' || l_linenumber AS stop_name, stop_id, ((p * 61) % 86400)::INTEGER AS scheduled_s
    FROM m JOIN (SELECT 'Stop ' || p_partkey AS stop_name, 100 + p_partkey AS stop_id FROM part WHERE p_partkey <> 6) s ON s.stop_name = 'Stop ' || l_linenumber""")
def _(t):
    wide = t.raw("lineitem").groupBy("l_orderkey").pivot("l_linenumber", list(range(1, 8))).agg(F.min("l_partkey"))
    named = wide.select("l_orderkey", *[T.seconds_to_clock((F.col(f"`{i}`") * 61) % 86400).alias(f"Stop {i}") for i in range(1, 8)])
    # one stop of the timetable is not known
    mapping = t.raw("part").where("p_partkey <> 6").select(F.concat(F.lit("Stop "), F.col("p_partkey").cast("string")).alias("stop_name"), (F.col("p_partkey") + 100).alias("stop_id"))
    blocks = readers.column_blocks(["Stop 1", "Stop 2", "Stop 3", None, "Stop 4", "Stop 5", "", "Stop 6", "Stop 7"])
    by_route = dict(zip(("north", "east", "south"), blocks, strict=True))
    return readers.unpivot_timetable(named, "l_orderkey", by_route, mapping).select("l_orderkey", "route", "stop_name", "stop_id", "scheduled_s")


@query("src11_flatten_json", """
    SELECT c_custkey AS id, c_nationkey AS home_nation_key, c_name AS home_nation_label, '{"balance":' || CAST(c_custkey AS VARCHAR) || '}' AS home_nation_money, '[' || c_custkey || ',' || c_nationkey || ']' AS list FROM customer""")
def _(t):
    c = F.col
    nested = t.raw("customer").select(
        c("c_custkey").alias("id"), F.array("c_custkey", c("c_nationkey").cast("long")).alias("list"),
        F.struct(F.struct(c("c_nationkey").alias("key"), c("c_name").alias("label"), F.struct(c("c_custkey").alias("balance")).alias("money")).alias("nation")).alias("home"))
    return readers.flatten_json(nested)


@query("src12_split_by_service_day", "WITH d AS (SELECT (ts_ms - 21600000) // 86400000 AS service_day, count(*) AS n FROM pings GROUP BY 1) SELECT service_day, n, (SELECT max(service_day) + 1 FROM d) AS resume_day FROM d")
def _(t):
    path = folder(t, "days")
    writers.split_by_service_day(t.pings, path)
    back = t.spark.read.parquet(path).withColumn("service_day", F.col("service_day").cast("long"))
    return writers.service_day_counts(back)


@query("snk1_write_table", "SELECT kind, count(*) AS n, round(sum(speed), 4) AS total FROM pings GROUP BY kind")
def _(t):
    path = folder(t, "table")
    writers.write_table(t.pings, path, ["kind"])
    return rounded(t.spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("total")), 4)


@query("snk2_compact_types", "SELECT event_id, route_id::INTEGER AS route_id, status::INTEGER AS status, round(speed::FLOAT::DOUBLE, 4) AS speed, CASE WHEN speed > 50 THEN 1 ELSE 0 END AS fast FROM pings")
def _(t):
    small = writers.compact_types(t.pings.select("event_id", "route_id", "status", "speed", (F.col("speed") > 50).alias("fast")))
    return small.select("event_id", F.col("route_id").cast("int").alias("route_id"), F.col("status").cast("int").alias("status"), near(F.col("speed").cast("double"), 4).alias("speed"), F.col("fast").cast("int").alias("fast"))


@query("snk3_patch_columns", "SELECT event_id, round(speed * 2, 6) AS speed, heading, kind FROM pings")
def _(t):
    featured = t.pings.select("event_id", "speed", "heading", "kind")
    rebuilt = t.pings.select("event_id", near(F.col("speed") * 2).alias("speed"))
    return writers.patch_columns(featured, rebuilt, ["speed"], ["event_id"])


@query("snk5_views", "SELECT r.long_name, count(*) AS n_trips FROM routes r JOIN trips t ON t.route_id = r.route_id GROUP BY 1")
def _(t):
    writers.register_views({"pl_routes": t.routes, "pl_trips": t.trips})
    return t.spark.sql("SELECT r.long_name, count(*) AS n_trips FROM pl_routes r JOIN pl_trips t ON t.route_id = r.route_id GROUP BY r.long_name")
