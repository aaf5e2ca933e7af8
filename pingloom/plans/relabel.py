"""The driver's tables read as transit tables, by integer arithmetic both engines share.

``Frames`` gives the Spark frames; ``CTES`` the same tables as SQL, used by the oracle.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingloom.functions.times import floor_div, ts_to_ms
from pingloom.session import pin_session

# Each SQL text below says how a transit table is made; Frames builds the same one with the API.
CTES: dict[str, str] = {
    "pings": """
        SELECT event_id, user_id AS vehicle_id,
               CASE WHEN user_id % 31 = 0 THEN 'jAUnt ' ELSE 'bus ' END || user_id AS vehicle_name,
               user_id % 10 AS route_id, epoch_us(ts) // 1000 AS ts_ms, value AS speed,
               (event_id % 1000)::DOUBLE / 1000 AS progress,
               32.5::DOUBLE + ((event_id * 7919) % 1000)::DOUBLE / 5000 AS lat,
               -85.6::DOUBLE + ((event_id * 104729) % 1000)::DOUBLE / 5000 AS lon,
               ((event_id * 37) % 360)::DOUBLE AS heading, (event_id * 7) % 60 AS passenger_load,
               CASE WHEN event_id % 97 = 0 THEN 9998 ELSE event_id % 5 END AS pattern_id,
               CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 71 WHEN 2 THEN 7 ELSE 0 END AS status,
               (event_id * 13) % 12 AS last_stop_id, (event_id * 13 + 1) % 12 AS next_stop_id,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE epoch_us(ts) // 1000 - ((event_id * 17) % 900) * 1000 END AS last_stop_time_ms,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id % 9 - 2)::DOUBLE END AS last_stop_on_time,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE ((event_id * 29) % 1440)::DOUBLE END AS eta_minutes,
               event_type AS kind
        FROM events""",
    "arrivals": """
        SELECT event_id, user_id AS vehicle_id, user_id % 10 AS route_id, (event_id * 13) % 12 AS stop_id,
               'Stop ' || ((event_id * 13) % 12) AS station, epoch_us(ts) // 1000 AS arrival_ms,
               epoch_us(ts) // 1000 + (round(value) * 1000)::BIGINT AS departure_ms, value AS dwell_s
        FROM events WHERE event_type = 'purchase' OR event_type = 'signup'""",
    "weather": """
        SELECT epoch_us(ts) // 3600000000 * 3600000 AS hour_ms, min(value) AS temperature_c,
               sum(event_id % 7)::DOUBLE / 10 AS precipitation_mm
        FROM events WHERE event_type = 'view' GROUP BY 1""",
    "stop_times": """
        SELECT l_orderkey AS trip_id, o_custkey % 10 AS route_id,
               (o_custkey % 10) * 5 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS shape_id,
               row_number() OVER w AS stop_sequence, l_partkey % 12 AS stop_id,
               sum(l_quantity) OVER w AS shape_dist
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
                     ROWS UNBOUNDED PRECEDING)""",
    "trips": """
        SELECT o_orderkey AS trip_id, o_custkey % 10 AS route_id,
               (o_custkey % 10) * 5 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS shape_id,
               o_orderstatus AS service_id
        FROM orders""",
    "routes": """
        SELECT s_suppkey AS route_id, s_name AS long_name, s_nationkey AS color FROM supplier""",
    "stops": """
        SELECT p_partkey AS stop_id, p_name || ' & ' || p_partkey AS stop_name,
               32.5::DOUBLE + ((p_partkey * 631) % 1000)::DOUBLE / 5000 AS lat,
               -85.6::DOUBLE + ((p_partkey * 877) % 1000)::DOUBLE / 5000 AS lon
        FROM part""",
    # a serpentine polyline per shape
    "shapes": """
        SELECT p_partkey % 10 AS shape_id, p_partkey // 10 AS seq,
               32.50037::DOUBLE + (p_partkey % 10)::DOUBLE * 0.00031::DOUBLE
                 + (CASE WHEN (p_partkey // 200) % 2 = 0 THEN (p_partkey // 10) % 20 ELSE 19 - (p_partkey // 10) % 20 END)::DOUBLE / 100 AS lat,
               -85.59963::DOUBLE + ((p_partkey // 200) % 20)::DOUBLE / 100 + (p_partkey // 4000)::DOUBLE * 0.00013::DOUBLE AS lon,
               (p_partkey // 10)::DOUBLE * 0.7::DOUBLE AS dist
        FROM part""",
    "predictions": """
        SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
               l_extendedprice / 50 AS actual, l_quantity * 20 + (l_partkey % 97) AS baseline,
               (l_suppkey % 41 - 20)::DOUBLE AS pred_residual, l_suppkey % 10 AS route_id,
               l_linenumber AS stops_away, (l_orderkey * 7) % 24 AS hour,
               (l_partkey % 60)::DOUBLE * 100 AS distance_m, l_quantity AS speed,
               CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_tax * 1000 END AS schedule_eta
        FROM lineitem""",
}
# the same pings with what a feed may lack or get wrong: missing values, and places outside the service area
CTES["rough"] = """
        SELECT * REPLACE (
            CASE WHEN event_id % 41 <> 0 THEN pattern_id END AS pattern_id, CASE WHEN event_id % 43 <> 0 THEN route_id END AS route_id,
            CASE WHEN event_id % 47 <> 0 THEN progress END AS progress, CASE WHEN event_id % 53 <> 0 THEN next_stop_id END AS next_stop_id,
            CASE WHEN event_id % 59 <> 0 THEN speed END AS speed, CASE WHEN event_id % 61 <> 0 THEN vehicle_name END AS vehicle_name,
            CASE WHEN event_id % 61 <> 0 THEN vehicle_id END AS vehicle_id,
            CASE event_id % 37 WHEN 0 THEN lat + 0.25::DOUBLE WHEN 1 THEN lat - 3 ELSE lat END AS lat,
            CASE event_id % 37 WHEN 2 THEN lon + 0.3::DOUBLE ELSE lon END AS lon)
        FROM pings"""
CTES["eta"] = """
        SELECT *, baseline + pred_residual AS predicted, baseline + pred_residual - actual AS err,
               abs(baseline + pred_residual - actual) AS abs_err
        FROM predictions"""
CTES["canonical"] = """
        SELECT route_id, shape_id FROM (
            SELECT route_id, shape_id, row_number() OVER (PARTITION BY route_id ORDER BY count(DISTINCT trip_id) DESC, shape_id) AS rn
            FROM stop_times GROUP BY route_id, shape_id) WHERE rn = 1"""
CTES["stop_seq"] = """
        SELECT f.route_id, f.stop_id, f.stop_sequence, f.shape_dist, m.max_dist, f.shape_dist / m.max_dist AS stop_progress
        FROM (SELECT route_id, stop_id, min(stop_sequence) AS stop_sequence,
                     arg_min(shape_dist, stop_sequence * 1000000000 + trip_id) AS shape_dist
              FROM stop_times JOIN canonical USING (route_id, shape_id) GROUP BY route_id, stop_id) f
        JOIN (SELECT route_id, max(shape_dist) AS max_dist FROM stop_times JOIN canonical USING (route_id, shape_id)
              GROUP BY route_id) m USING (route_id)"""
CTES["ahead"] = """
        SELECT * EXCLUDE (rn), rn AS stops_away FROM (
            SELECT p.*, s.stop_id AS target_stop_id, s.stop_sequence AS target_stop_sequence, s.stop_progress AS target_stop_progress,
                   row_number() OVER (PARTITION BY p.event_id ORDER BY s.stop_progress, s.stop_sequence, s.stop_id) AS rn
            FROM pings p JOIN stop_seq s USING (route_id) WHERE s.stop_progress > p.progress) WHERE rn <= 4"""
# labels reach 20 days ahead because a driver "vehicle" reports every ten hours only
CTES["labeled"] = """
        SELECT a.*, r.arrival_ms AS actual_arrival_ms, (r.arrival_ms - a.ts_ms)::DOUBLE / 1000 AS label_s,
               l.stop_progress AS last_stop_progress, CASE WHEN (a.ts_ms // 86400000 + 3) % 7 < 5 THEN 1 ELSE 0 END AS day_type,
               (((a.ts_ms // 3600000) - 6) % 24)::INTEGER AS hour_ct, a.ts_ms // 86400000 AS day
        FROM ahead a ASOF LEFT JOIN arrivals r
          ON a.route_id = r.route_id AND a.target_stop_id = r.stop_id AND a.vehicle_id = r.vehicle_id AND a.ts_ms <= r.arrival_ms
        LEFT JOIN stop_seq l ON l.route_id = a.route_id AND l.stop_id = a.last_stop_id
        WHERE r.arrival_ms - a.ts_ms <= 1728000000 AND r.arrival_ms > a.ts_ms"""
CTES["train"] = "SELECT * FROM labeled WHERE day BETWEEN 0 AND 19742"
CTES["test"] = "SELECT * FROM labeled WHERE day BETWEEN 19744 AND 999999"

LABEL_REACH_MS = 1_728_000_000
TRAIN_DAYS = (0, 19742)
TEST_DAYS = (19744, 999999)


def oracle(sql: str) -> str:
    """Prefix a query with the table definitions it (transitively) names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_body(name, body)

    def visit_body(name: str, body: str) -> None:
        for other, other_body in CTES.items():
            if other != name and other not in needed and re.search(rf"(FROM|JOIN)\s+{other}\b", body):
                visit_body(other, other_body)
        needed.append(name)

    visit(sql)
    sql = sql.strip()
    heads = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{sql[15:]}" if heads else sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {heads},\n{sql[5:]}" if heads else sql
    return f"WITH {heads}\n{sql}" if heads else sql


class Frames:
    """Lazily built Spark frames over one directory of driver tables."""

    def streamed(self) -> StreamFrames:
        """The same frames fed by file streams (only those built without joins or aggregates)."""
        return StreamFrames(self.spark, self.sf_dir)

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = pin_session(spark)
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pings(self) -> DataFrame:
        e = F.col("event_id")
        ms = ts_to_ms("ts")
        status = F.when(e % 4 == 1, 71).when(e % 4 == 3, 0).otherwise(7)
        return self.raw("events").select(
            e,
            F.col("user_id").alias("vehicle_id"),
            F.concat(F.when(F.col("user_id") % 31 == 0, "jAUnt ").otherwise("bus "), F.col("user_id").cast("string")).alias("vehicle_name"),
            (F.col("user_id") % 10).alias("route_id"),
            ms.alias("ts_ms"),
            F.col("value").alias("speed"),
            ((e % 1000) / F.lit(1000.0)).alias("progress"),
            (F.lit(32.5) + ((e * 7919) % 1000) / F.lit(5000.0)).alias("lat"),
            (F.lit(-85.6) + ((e * 104729) % 1000) / F.lit(5000.0)).alias("lon"),
            ((e * 37) % 360).cast("double").alias("heading"),
            ((e * 7) % 60).alias("passenger_load"),
            F.when(e % 97 == 0, F.lit(9998)).otherwise(e % 5).alias("pattern_id"),
            status.alias("status"),
            ((e * 13) % 12).alias("last_stop_id"),
            ((e * 13 + 1) % 12).alias("next_stop_id"),
            F.when(e % 23 != 0, ms - ((e * 17) % 900) * 1000).alias("last_stop_time_ms"),
            F.when(e % 19 != 0, (e % 9 - 2).cast("double")).alias("last_stop_on_time"),
            F.when(e % 11 != 0, ((e * 29) % 1440).cast("double")).alias("eta_minutes"),
            F.col("event_type").alias("kind"),
        )

    @cached_property
    def rough(self) -> DataFrame:
        e = F.col("event_id")
        lacking = {"pattern_id": 41, "route_id": 43, "progress": 47, "next_stop_id": 53, "speed": 59, "vehicle_name": 61, "vehicle_id": 61}
        off = e % 37
        return self.pings.withColumns({
            **{c: F.when(e % n != 0, F.col(c)) for c, n in lacking.items()},
            "lat": F.when(off == 0, F.col("lat") + F.lit(0.25)).when(off == 1, F.col("lat") - 3).otherwise(F.col("lat")),
            "lon": F.when(off == 2, F.col("lon") + F.lit(0.3)).otherwise(F.col("lon")),
        })

    @cached_property
    def arrivals(self) -> DataFrame:
        e = F.col("event_id")
        ms = ts_to_ms("ts")
        return self.raw("events").where(F.col("event_type").isin("purchase", "signup")).select(
            e,
            F.col("user_id").alias("vehicle_id"),
            (F.col("user_id") % 10).alias("route_id"),
            ((e * 13) % 12).alias("stop_id"),
            F.concat(F.lit("Stop "), ((e * 13) % 12).cast("string")).alias("station"),
            ms.alias("arrival_ms"),
            (ms + (F.round("value") * 1000).cast("long")).alias("departure_ms"),
            F.col("value").alias("dwell_s"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        hour = (floor_div(ts_to_ms("ts"), 3_600_000) * 3_600_000).alias("hour_ms")
        return self.raw("events").where("event_type = 'view'").groupBy(hour).agg(
            F.min("value").alias("temperature_c"), (F.sum(F.col("event_id") % 7) / F.lit(10.0)).alias("precipitation_mm")
        )

    @cached_property
    def trips(self) -> DataFrame:
        route = F.col("o_custkey") % 10
        shape = route * 5 + F.substring("o_orderpriority", 1, 1).cast("long") - 1
        return self.raw("orders").select(
            F.col("o_orderkey").alias("trip_id"), route.alias("route_id"), shape.alias("shape_id"),
            F.col("o_orderstatus").alias("service_id"),
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("trip_id"),
            F.row_number().over(w).cast("long").alias("stop_sequence"),
            (F.col("l_partkey") % 12).alias("stop_id"),
            F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("shape_dist"),
        )
        return lines.join(self.trips, "trip_id").select(
            "trip_id", "route_id", "shape_id", "stop_sequence", "stop_id", "shape_dist"
        )

    @cached_property
    def routes(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("route_id"), F.col("s_name").alias("long_name"), F.col("s_nationkey").alias("color")
        )

    @cached_property
    def stops(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("stop_id"),
            F.concat(F.col("p_name"), F.lit(" & "), k.cast("string")).alias("stop_name"),
            (F.lit(32.5) + ((k * 631) % 1000) / F.lit(5000.0)).alias("lat"),
            (F.lit(-85.6) + ((k * 877) % 1000) / F.lit(5000.0)).alias("lon"),
        )

    @cached_property
    def shapes(self) -> DataFrame:
        k = F.col("p_partkey")
        shape, seq, column = k % 10, floor_div(k, 10), floor_div(k, 200)
        step = F.when(column % 2 == 0, seq % 20).otherwise(F.lit(19) - seq % 20)
        return self.raw("part").select(
            shape.alias("shape_id"),
            seq.alias("seq"),
            (F.lit(32.50037) + shape.cast("double") * F.lit(0.00031) + step / F.lit(100.0)).alias("lat"),
            (F.lit(-85.59963) + (column % 20) / F.lit(100.0) + floor_div(k, 4000).cast("double") * F.lit(0.00013)).alias("lon"),
            (seq.cast("double") * F.lit(0.7)).alias("dist"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        c = F.col
        return self.raw("lineitem").select(
            c("l_orderkey").alias("order_id"),
            c("l_linenumber").alias("line"),
            c("l_partkey").alias("part_id"),
            c("l_suppkey").alias("supp_id"),
            (c("l_extendedprice") / 50).alias("actual"),
            (c("l_quantity") * 20 + c("l_partkey") % 97).alias("baseline"),
            (c("l_suppkey") % 41 - 20).cast("double").alias("pred_residual"),
            (c("l_suppkey") % 10).alias("route_id"),
            c("l_linenumber").alias("stops_away"),
            ((c("l_orderkey") * 7) % 24).alias("hour"),
            ((c("l_partkey") % 60).cast("double") * 100).alias("distance_m"),
            c("l_quantity").alias("speed"),
            F.when(c("l_orderkey") % 17 != 0, c("l_tax") * 1000).alias("schedule_eta"),
        )

    @cached_property
    def eta(self) -> DataFrame:
        from pingloom.operators.metrics import with_errors

        return with_errors(self.predictions.withColumn("predicted", F.col("baseline") + F.col("pred_residual")), "actual", "predicted")

    @cached_property
    def stop_seq(self) -> DataFrame:
        """The network's stop sequences, a written dimension table."""
        from pingloom.operators.network import canonical_shape, stop_sequences
        from pingloom.plans.stages import materialize

        times = materialize(self.stop_times)
        return materialize(stop_sequences(times, canonical_shape(times)))

    @cached_property
    def ahead(self) -> DataFrame:
        from pingloom.operators.joins import explode_stops_ahead

        return explode_stops_ahead(self.pings, self.stop_seq, k=4)

    @cached_property
    def labeled(self) -> DataFrame:
        """Ping-stop rows with their label: the stage everything historical is fitted on, written once."""
        from pingloom.functions.times import epoch_day, local_hour, weekday
        from pingloom.operators.joins import asof_next, lookup_left
        from pingloom.plans.stages import materialize

        matched = asof_next(
            self.ahead, self.arrivals.withColumnRenamed("stop_id", "target_stop_id"),
            ["route_id", "target_stop_id", "vehicle_id"], "ts_ms", "arrival_ms", LABEL_REACH_MS, "actual_arrival_ms",
        ).where("actual_arrival_ms > ts_ms")
        last = self.stop_seq.select(
            "route_id", F.col("stop_id").alias("last_stop_id"), F.col("stop_progress").alias("last_stop_progress")
        )
        return materialize(lookup_left(matched, last, ["route_id", "last_stop_id"]).select(
            "*",
            ((F.col("actual_arrival_ms") - F.col("ts_ms")) / F.lit(1000.0)).alias("label_s"),
            (weekday("ts_ms") < 5).cast("int").alias("day_type"),
            local_hour("ts_ms").alias("hour_ct"),
            epoch_day("ts_ms").alias("day"),
        ))

    @cached_property
    def train(self) -> DataFrame:
        return self.labeled.where(F.col("day").between(*TRAIN_DAYS))

    @cached_property
    def test(self) -> DataFrame:
        return self.labeled.where(F.col("day").between(*TEST_DAYS))


class StreamFrames(Frames):
    """Frames whose raw tables are read as streams."""

    def raw(self, name: str) -> DataFrame:
        from pingloom.streaming.live import table_stream

        return table_stream(self.spark, self.sf_dir, super().raw(name).schema, f"{name}.parquet")
