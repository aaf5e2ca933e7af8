"""Streams of telemetry packets and what is kept live. Each stateful operator has a batch twin."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingloom.plans.slices import SLICE, in_ranges
from pingloom.plans.stages import materialize
from pingloom.session import shared_folder
from pingloom.streaming.processors import HISTORY_SCHEMA, SILENCE_SCHEMA, SMOOTH_SCHEMA, HistoryProcessor, SilenceProcessor, Smoothing, SmoothProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def telemetry_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """JSON packets appended as files; each trigger takes at most ``max_files``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def table_stream(spark: SparkSession, folder: str, schema, file_glob: str, max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; each trigger takes at most ``max_files``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process all available input, one folder per micro-batch (a repeated batch overwrites its own), read back."""
    spark = stream.sparkSession
    base = f"{folder or shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    stored: list[int] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        stored.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        .foreachBatch(store).start()
    )
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    if not stored:  # no input, so no batch has made the folder
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/out")


def latest_positions(df: DataFrame, key: str = "vehicle_id", order: tuple[str, ...] = ("ts_ms", "event_id")) -> DataFrame:
    """Newest row per vehicle; works on a stream (update mode) and on a table."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_p")).select(key, "_p.*")


def merge_updates(updates: DataFrame, key: str) -> DataFrame:
    """The last update per key of an update-mode sink."""
    rest = [c for c in updates.columns if c not in (key, "batch_id")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_p")).select(key, "_p.*")


def drop_stale(df: DataFrame, now_ms: Column, limit_ms: int = 120_000, ts: str = "ts_ms", inclusive: bool = True) -> DataFrame:
    age = now_ms - F.col(ts)
    return df.where((age <= limit_ms) if inclusive else (age < limit_ms))


def trip_eta(updates: DataFrame, now_s: Column) -> DataFrame:
    """Per trip the first listed stop arriving after now, seconds to it, and the delay; stateless, so streams work too."""
    ahead = F.get(F.filter("stop_time_update", lambda s: (s["arrival_time"] > now_s) & s["stop_id"].isNotNull()), F.lit(0))
    return updates.where("trip_id IS NOT NULL").select(
        "trip_id", ahead["stop_id"].alias("next_stop_id"), F.coalesce(ahead["arrival_time"] - now_s, F.lit(0)).alias("eta_seconds"),
        F.coalesce("delay", F.lit(0)).alias("delay"))


def enrich_stream(positions: DataFrame, etas: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Positions joined with ETAs of the same trip at most the watermark older; unmatched positions come out late, with NULLs.

    Both sides need ``trip_id`` and an event time (``ts`` / ``eta_ts``).
    """
    left = positions.withWatermark("ts", watermark)
    right = etas.withColumnRenamed("trip_id", "_trip").withWatermark("eta_ts", watermark)
    near = (F.col("trip_id") == F.col("_trip")) & F.expr(f"eta_ts BETWEEN ts - INTERVAL {watermark} AND ts")
    return left.join(right, near, "leftOuter").drop("_trip")


def _time_mode(ttl_ms: int | None) -> str:
    # expiry needs the clock, and a stream on the clock never runs out of batches
    return "ProcessingTime" if ttl_ms else "None"


def history_state(stream: DataFrame, span_ms: int = 90_000, compare_ms: int = 30_000, ttl_ms: int | None = None) -> DataFrame:
    """Rolling features from a per-vehicle buffer; rows of a vehicle must arrive in time order across triggers.

    A service that runs on sets ``ttl_ms``: the state of a vehicle that stays silent for so long is dropped.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select("vehicle_id", "event_id", "ts_ms", "speed", "progress")
    return rows.groupBy("vehicle_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(span_ms, compare_ms, ttl_ms), outputStructType=HISTORY_SCHEMA, outputMode="Append", timeMode=_time_mode(ttl_ms))


def smooth_state(stream: DataFrame, alpha: float = 0.3, bypass_s: float = 60.0, max_rise_s: float = 30.0, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Smoothed ETA per vehicle: moving average, bypassed on jumps, monotone guard, reset on a change of route or (where known) trip.

    ``ttl_ms`` as for :func:`history_state`. ``initial``: results of :func:`smooth_state_batch` that the stream goes on from; each
    vehicle begins with its last state in them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    trip = F.col("trip_id").cast("string") if "trip_id" in stream.columns else F.lit(None).cast("string")
    rows = stream.select("vehicle_id", "route_id", trip.alias("trip_id"), "event_id", "ts_ms", "progress", "eta_s")
    return rows.groupBy("vehicle_id").transformWithStateInPandas(
        statefulProcessor=SmoothProcessor(Smoothing(alpha, bypass_s, max_rise_s), ttl_ms), outputStructType=SMOOTH_SCHEMA, outputMode="Append", timeMode=_time_mode(ttl_ms),
        **({"initialState": last_states(initial).groupBy("vehicle_id")} if initial is not None else {}))


def last_states(smoothed: DataFrame) -> DataFrame:
    """The state each vehicle ends with, from :func:`smooth_state_batch`."""
    state = F.struct("route_id", "trip_id", "progress", F.col("smoothed_s").alias("smoothed"))
    last = smoothed.where("vehicle_id IS NOT NULL").groupBy("vehicle_id").agg(F.max_by(state, F.struct("ts_ms", "event_id")).alias("_s"))
    return last.select("vehicle_id", F.col("_s.route_id").cast("long").alias("route_id"), "_s.trip_id", "_s.progress", "_s.smoothed")


def silent_vehicles(stream: DataFrame, idle_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(vehicle_id, last_ms, silent_ms): a row whenever a vehicle has sent nothing for ``idle_ms``, and its state is dropped then.

    Timers run on event time: a vehicle's silence is told by the watermark passing, that is by the packets of others, so neither a
    packet of its own nor a clock is needed, and a run over available data shows it. ``stream`` needs ``vehicle_id`` and ``ts_ms``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where("vehicle_id IS NOT NULL").select("vehicle_id", "ts_ms", F.timestamp_millis("ts_ms").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("vehicle_id").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(idle_ms), outputStructType=SILENCE_SCHEMA, outputMode="Append", timeMode="EventTime")


def changed_only(stream: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Repeats of a vehicle's position and time dropped; state is freed behind the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["vehicle_id", "lat", "lon", ts])


def packets_per_window(df: DataFrame, ts: str, width: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Packets per tumbling window and the newest packet's time."""
    source = df.withWatermark(ts, delay) if delay else df
    return source.groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts")).select(
        F.unix_millis("window.start").alias("window_ms"), "n", F.unix_millis("last_ts").alias("last_ms"))


def next_stops_topk(df: DataFrame, minutes: str, stops: DataFrame, key: str, k: int = 3) -> DataFrame:
    """First ``k`` upcoming stops with names; an unknown stop reads 'Unknown'."""
    top = df.select(key, F.posexplode(F.slice(minutes, 1, k)).alias("pos", "_s")).select(key, "pos", F.col("_s.stop_id").alias("stop_id"), F.col("_s.minutes").alias("minutes"))
    return top.join(stops.select("stop_id", "stop_name"), "stop_id", "left").withColumn("stop_name", F.coalesce("stop_name", F.lit("Unknown")))


def alerts_active(alerts: DataFrame, now_s: Column) -> DataFrame:
    """Alerts running now (no period means always), texts in English, else the first language."""
    def text(field: str) -> Column:
        english = F.filter(field, lambda t: t["language"].isNull() | t["language"].isin("en", ""))
        return F.coalesce(F.get(english, F.lit(0))["text"], F.get(F.col(field), F.lit(0))["text"], F.lit(""))

    running = F.exists("periods", lambda p: (p["start_s"] <= now_s) & (p["end_s"].isNull() | (p["end_s"] >= now_s)))
    always = F.coalesce(F.size("periods") <= 0, F.lit(True))
    return alerts.where(always | running).select("id", text("header").alias("header"), text("description").alias("description"), "route_ids")


def service_hours_gate(df: DataFrame, hour: Column, first: int = 6, last: int = 22) -> DataFrame:
    return df.where((hour >= first) & (hour < last))


# batch twins of the smoothing state

def smooth_batch(df: DataFrame, alpha: float = 0.3, bypass_s: float = 60.0) -> DataFrame:
    """Moving average over each vehicle's time-ordered ETAs: (vehicle_id, event_id, eta_s, smoothed_s)."""
    rows = df.select("vehicle_id", F.lit(0).cast("long").alias("route_id"), F.lit(None).cast("string").alias("trip_id"), "event_id", "ts_ms", F.lit(0.0).alias("progress"), "eta_s")
    return fold_in_order(rows, Smoothing(alpha, bypass_s, float("inf"))).select("vehicle_id", "event_id", "eta_s", "smoothed_s")


def smooth_state_batch(df: DataFrame, alpha: float = 0.3, bypass_s: float = 60.0, max_rise_s: float = 30.0) -> DataFrame:
    """What :func:`smooth_state` puts out, from a table: all columns of its state beside the result, so that a stream can go on from it."""
    trip = F.col("trip_id").cast("string") if "trip_id" in df.columns else F.lit(None).cast("string")
    return fold_in_order(df.select("vehicle_id", "route_id", trip.alias("trip_id"), "event_id", "ts_ms", "progress", "eta_s"), Smoothing(alpha, bypass_s, max_rise_s))


FOLD_ROWS = 200_000  # of a range, which one task folds in Python


def fold_in_order(df: DataFrame, smoothing: Smoothing) -> DataFrame:
    """Each vehicle's smoothing, whose values depend on the ones before, folded in parallel.

    Rows are cut into ranges of about equal size in the order of vehicle and time; a vehicle may span many. Each range is folded at
    once, its first vehicle as if it began there, and hands over the state it ends with in one row. A range whose true start differs
    is folded again from it. The average forgets its start within some hundred rows, after which both folds agree to the last bit, so
    what ranges hand over doesn't change any more after the second fold. (If it did, ranges would be folded again until it doesn't:
    the result is that of one pass through all rows, whatever the cuts.) A row without a vehicle is not smoothed.
    """
    rows = df.select("vehicle_id", "route_id", "trip_id", "event_id", "ts_ms", F.col("progress").cast("double").alias("progress"), F.col("eta_s").cast("double").alias("eta_s"))
    cut = in_ranges(materialize(rows), ["vehicle_id", "ts_ms", "event_id"], "range", FOLD_ROWS)
    kept = cut.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    start = "vehicle BIGINT, state STRUCT<route_id: BIGINT, trip_id: STRING, progress: DOUBLE, smoothed: DOUBLE>"

    def fold(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vehicle_id", "ts_ms", "event_id"], kind="stable", na_position="first")
        vehicle, state = None, None
        if len(begin):
            given = begin["state"].iloc[0]
            vehicle, state = int(begin["vehicle"].iloc[0]), tuple(given[k] for k in ("route_id", "trip_id", "progress", "smoothed"))
        values = []
        for v, *r in zip(*(pdf[c].tolist() for c in ("vehicle_id", "route_id", "trip_id", "progress", "eta_s")), strict=True):
            state = smoothing.step(state if v == vehicle else None, *r)
            vehicle = v
            values.append(state[3])
        return pdf.assign(smoothed_s=values)

    def folded(part: DataFrame, starts: DataFrame) -> DataFrame:
        return materialize(part.groupBy("range").cogroup(starts.groupBy("range")).applyInPandas(fold, f"{kept}, smoothed_s double"))

    spark = df.sparkSession
    out = folded(cut, spark.createDataFrame([], f"range INT, {start}"))
    used = spark.createDataFrame([], f"range INT, {start}")
    ends_of = lambda done: done.groupBy("range").agg(
        F.min(F.struct("vehicle_id", "ts_ms", "event_id"))["vehicle_id"].alias("first"),
        F.max_by(F.struct(F.col("vehicle_id").alias("vehicle"), F.struct(F.col("route_id").cast("long").alias("route_id"), "trip_id", "progress", F.col("smoothed_s").alias("smoothed")).alias("state")), F.struct("vehicle_id", "ts_ms", "event_id")).alias("end"))
    finished, ends = out, materialize(ends_of(out))
    while True:
        # a row a range
        before = F.lag("end").over(Window.orderBy("range"))
        starts = ends.withColumn("_b", before).where(F.col("_b.vehicle") == F.col("first")).select("range", "_b.vehicle", "_b.state")
        same = used.select(F.col("range").alias("_r"), F.col("state").alias("_s"))
        new = materialize(starts.join(same, (F.col("range") == F.col("_r")) & F.col("state").eqNullSafe(F.col("_s")), "left_anti"))
        if not new.limit(1).count():
            return finished.select("vehicle_id", "event_id", "ts_ms", "eta_s", "smoothed_s", "route_id", "trip_id", "progress")
        again = new.select("range")
        redone = folded(cut.join(again, "range", "left_semi"), new)
        finished = materialize(finished.join(again, "range", "left_anti").unionByName(redone))
        ends = materialize(ends.join(again, "range", "left_anti").unionByName(ends_of(redone)))
        used = materialize(used.join(again, "range", "left_anti").unionByName(new))


def silent_vehicles_batch(df: DataFrame, idle_ms: int, until_ms: Column) -> DataFrame:
    """What :func:`silent_vehicles` puts out, from a table: ``until_ms`` is how far the stream's watermark came."""
    from pingloom.plans.slices import with_slice

    seen = materialize(df.where("vehicle_id IS NOT NULL AND ts_ms IS NOT NULL").select("vehicle_id", "ts_ms").distinct())
    # the next packet after each, across slices: one summary row a slice
    size = max(idle_ms, 1)
    cut = with_slice(seen, "ts_ms", size)
    w = Window.partitionBy("vehicle_id", SLICE).orderBy("ts_ms")
    heads = cut.groupBy("vehicle_id", SLICE).agg(F.min("ts_ms").alias("_head"))
    following = heads.select("vehicle_id", SLICE, F.lead("_head").over(Window.partitionBy("vehicle_id").orderBy(SLICE)).alias("_after"))
    gaps = cut.withColumn("_next", F.lead("ts_ms").over(w)).join(following, ["vehicle_id", SLICE]).withColumn("_next", F.coalesce("_next", "_after"))
    ends = F.col("ts_ms") + F.lit(idle_ms)
    return gaps.where((F.col("_next") > ends) | (F.col("_next").isNull() & (ends <= until_ms))).select("vehicle_id", F.col("ts_ms").alias("last_ms"), ends.alias("silent_ms"))


def monotone_guard(eta: Column, previous: Column, progress: Column, previous_progress: Column, max_rise_s: float = 30.0) -> Column:
    """If the vehicle moved on, its ETA may rise by at most ``max_rise_s``."""
    limit = previous + F.lit(max_rise_s)
    return F.when((progress > previous_progress) & (eta > limit), limit).otherwise(eta)


def order_etas(etas: Column, low: float = 0.0, high: float = 3600.0, step_s: float = 30.0) -> Column:
    """Clamped ETAs of successive stops; one below its predecessor becomes the predecessor plus a step."""
    clamped = F.transform(etas, lambda e: F.greatest(F.least(e, F.lit(high)), F.lit(low)))
    empty = F.array().cast("array<double>")

    def put(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.when(last.isNotNull() & (e < last), last + F.lit(step_s)).otherwise(e)))

    return F.aggregate(clamped, empty, put)
