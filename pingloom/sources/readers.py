"""Telemetry, arrivals, weather, timetable, stop and GTFS files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingloom import schemas
from pingloom.config import HOUR_MS
from pingloom.functions.scalars import route_id_num
from pingloom.functions.times import clock_to_seconds, floor_div, local_text_to_utc_ms
from pingloom.operators.windows import dedupe_keep_first

BAD = "_bad"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with their file and, for lines that are no record, the raw text. Gzip is read by extension."""
    return (
        spark.read.schema(f"{schema}, {BAD} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )


def is_record(lines: DataFrame) -> Column:
    """Whether a line is a record. Its first column is read with the raw text, as Spark refuses to read that alone."""
    return F.concat(F.col(BAD), F.coalesce(F.col(lines.columns[0]).cast("string"), F.lit(""))).isNull()


def ingest_report(lines: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per file: records, malformed lines, and whether a required column is missing from all of them."""
    good = is_record(lines)
    present = [F.count(F.when(good, F.col(c))) > 0 for c in required]
    complete = present[0]
    for p in present[1:]:
        complete = complete & p
    return lines.groupBy("_file").agg(
        F.count_if(good).alias("n_records"), F.count_if(~good).alias("n_malformed"), (~complete).cast("int").alias("skipped"))


def read_telemetry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Flat telemetry under its engine names, and the ingest report. Files lacking a required column are left out."""
    lines = read_json_lines(spark, path, schemas.TELEMETRY_FLAT)
    report = ingest_report(lines, schemas.REQUIRED_FLAT)
    usable = lines.where(is_record(lines)).join(report.where("skipped = 0").select("_file"), "_file", "left_semi")
    return usable.select(*[F.col(src).alias(dst) for src, dst in schemas.TELEMETRY_NAMES.items()]), report


def normalize_telemetry(df: DataFrame) -> DataFrame:
    """Flat and nested records to one flat table; records without vehicle or time are dropped.

    A nested record's missing field reads 0 (the feed's own default), its vehicle is did, else aID, else vid.
    """
    c = F.col
    flat = c("vid").isNotNull() & c("lat").isNotNull()
    zero = lambda x: F.coalesce(x, F.lit(0))
    pick = lambda f, n: F.when(flat, f).otherwise(n)
    out = df.select(
        pick(c("t"), F.coalesce("ts", "t")).alias("ts_ms"),
        pick(c("vid"), F.coalesce("did", "aID", "vid")).alias("vehicle_id"),
        pick(c("lat"), c("lt")).alias("lat"),
        pick(c("lon"), c("ln")).alias("lon"),
        pick(c("heading"), zero(c("h"))).alias("heading"),
        pick(c("speed"), zero(c("v"))).alias("speed"),
        zero(c("load")).alias("passenger_load"),
        pick(c("routeId"), zero(c("serviceState.rID"))).alias("route_id"),
        pick(c("patternId"), zero(c("serviceState.patternID"))).alias("pattern_id"),
        pick(c("progress"), zero(c("serviceState.nextStopPercentProgress"))).alias("progress"),
        pick(c("lastStopId"), zero(c("lastStop.stopID"))).alias("last_stop_id"),
        pick(c("lastStopTime"), zero(c("lastStop.time"))).alias("last_stop_time_ms"),
        pick(c("lastStopOnTime"), zero(c("lastStop.onTime"))).alias("last_stop_on_time"),
        pick(c("nextStopId"), zero(c("eta.stopID"))).alias("next_stop_id"),
        pick(c("etaSeconds"), zero(c("eta.eta"))).alias("eta_minutes"),
        pick(c("scheduledEta"), zero(c("eta.seta"))).alias("scheduled_minutes"),
        F.coalesce("isDelayed", F.lit(False)).alias("is_delayed"),
        c("serviceState.status").alias("status"),
        c("serviceState.tripID").alias("trip_id"),
        c("schedule.stops").alias("schedule_stops"),
    )
    return out.where((F.col("vehicle_id") != "") & (F.col("ts_ms") > 0))


DATED = r'^"?[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"?,'


def titled_lines(spark: SparkSession, path: str, schema: str, header_start: str, record_start: str = DATED) -> DataFrame:
    """Lines of CSV files with a title line before the header, and what each is: title, header or record.

    All are recognised by content, so files can be split: the header begins with its first column's name; a record has all
    separators or begins like one (a cut-off record has too few); anything else is a title.
    """
    columns = len(schema.split(","))
    value = F.col("value")
    header = F.replace(value, F.lit('"'), F.lit("")).startswith(header_start)
    record = (F.size(F.split(value, ",")) >= columns) | value.rlike(record_start)
    kind = F.when(header, "header").when(record, "record").otherwise("title")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", kind.alias("kind"))


def read_titled_csv(spark: SparkSession, path: str, schema: str, header_start: str, record_start: str = DATED) -> DataFrame:
    """The records of titled CSV files; fields that a line lacks are NULL."""
    data = titled_lines(spark, path, schema, header_start, record_start).where("kind = 'record'")
    record = F.from_csv("value", F.lit(schema.replace("\n", " ")), {"mode": "PERMISSIVE"})
    return data.select(record.alias("_r")).select("_r.*")


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Arrival events of all matching files, texts trimmed."""
    raw = read_titled_csv(spark, path, schemas.ARRIVALS_CSV, "DATE,")
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def parse_arrivals(raw: DataFrame, tz: str = "US/Central") -> DataFrame:
    """Typed arrivals: rows out of service and on-demand vehicles left out, local times to UTC."""
    kept = raw.where(~F.col("Number").eqNullSafe("NIS") & ~F.coalesce(F.col("Vehicle ID").rlike("(?i)jaunt"), F.lit(False)))
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
    return kept.select(
        F.col("Vehicle ID").alias("vehicle_id"), F.col("Route").alias("route_name"), F.col("Station").alias("station"),
        local_text_to_utc_ms("DATE", "ARRIVAL", tz).alias("arrival_ms"),
        local_text_to_utc_ms("DATE", "DEPARTURE", tz).alias("departure_ms"),
        number("Dwell (sec)").alias("dwell_s"),
        (number("APC Boardings") + number("EPC Boardings")).alias("boardings"),
        (number("APC Alightings") + number("EPC Alightings")).alias("alightings"),
    )


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WEATHER_CSV).option("header", True).csv(path)


def weather_hours(raw: DataFrame, ts_ms: Column, temperature: str = "temperature_2m", precipitation: str = "precipitation",
                  order: Sequence[str] = (), probability: str = "precipitation_probability") -> DataFrame:
    """One row per hour, the first by time (or by ``order``), rain flag above 0.1 mm; a missing value fails the job.

    The probability of precipitation is kept where the table has it.
    """
    must = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"weather: {c} is missing")).cast("double"))
    rows = raw.withColumn("_ms", ts_ms).withColumn("hour_ms", floor_div("_ms", HOUR_MS) * HOUR_MS)
    first = dedupe_keep_first(rows, ["hour_ms"], list(order) or ["_ms", temperature, precipitation])
    return first.select(
        "hour_ms", must(temperature).alias("temperature_c"), must(precipitation).alias("precipitation_mm"),
        (F.col(precipitation) > 0.1).cast("int").alias("is_raining"), *([F.col(probability)] if probability in raw.columns else []))


def read_stops_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of stops (a network file)."""
    return spark.read.schema(schemas.STOPS_JSON).option("multiLine", True).json(path).select(
        F.col("id").try_cast("long").alias("stop_id"), F.trim("name").alias("stop_name"), "lat", "lon", "code")


def _gtfs_raw(spark: SparkSession, folder: str, name: str, encoding: str) -> DataFrame:
    raw = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').csv(f"{folder}/{name}.txt")
    return raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ")) for part in schema.split(",")]


def read_gtfs(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """The six text tables, kept columns only, picked by header name; a byte-order mark is tolerated.

    A file without one of its key columns (``schemas.GTFS_KEYS``) is an error; other columns it lacks are NULL.
    """
    out = {}
    for name, schema in schemas.GTFS.items():
        raw = _gtfs_raw(spark, folder, name, encoding)
        lacking = [c for c in schemas.GTFS_KEYS[name] if c not in raw.columns]
        if lacking:
            raise ValueError(f"{name}.txt lacks {', '.join(lacking)}")
        out[name] = raw.select(*[(F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in _fields(schema)])
    out["routes"] = out["routes"].withColumn("route_id_num", route_id_num("route_id"))
    return out


def gtfs_lost_values(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> DataFrame:
    """Per table and column: values that are there but are no value of the column's type, and missing key values."""
    reports = []
    for name, schema in schemas.GTFS.items():
        raw = _gtfs_raw(spark, folder, name, encoding)
        present = [(c, t) for c, t in _fields(schema) if c in raw.columns]
        lost = [F.count_if(F.col(c).isNotNull() & (F.trim(c) != "") & F.col(c).try_cast(t).isNull()).alias(c) for c, t in present]
        keys = schemas.GTFS_KEYS[name]
        missing = [F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c, _ in present if c in keys]
        counted = raw.agg(*lost, *missing)
        reports.append(counted.unpivot([], counted.columns, "what", "n").select(F.lit(name).alias("tbl"), "what", "n"))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.where("n > 0")


def unpivot_timetable(df: DataFrame, run: str, groups: Sequence[Sequence[str]] | dict[str, Sequence[str]], mapping: DataFrame) -> DataFrame:
    """Wide timetable (columns are stops, in blocks) to (route, stop, time); unmapped stops and blank cells drop.

    All blocks are unpivoted in one pass. ``mapping`` maps stop names to ids. Blocks named by their route add it as ``route``.
    """
    named_blocks = groups if isinstance(groups, dict) else {str(i): g for i, g in enumerate(groups)}
    columns = [c for group in named_blocks.values() for c in group]
    tall = df.unpivot([run], [f"`{c}`" for c in columns], "stop_name", "scheduled_time")
    route_of = F.create_map(*[F.lit(x) for route, group in named_blocks.items() for c in group for x in (c, route)])
    extra = [F.try_element_at(route_of, F.col("stop_name")).alias("route")] if isinstance(groups, dict) else []
    named = tall.select(run, *extra, F.trim("stop_name").alias("stop_name"), F.trim(F.col("scheduled_time").cast("string")).alias("scheduled_time"))
    present = named.where("scheduled_time IS NOT NULL AND scheduled_time <> ''")
    return present.join(mapping, "stop_name").withColumn("scheduled_s", clock_to_seconds("scheduled_time"))


def column_blocks(header: Sequence[str | None]) -> list[list[str]]:
    """Runs of named columns between blank ones (schema work, no data)."""
    blocks: list[list[str]] = [[]]
    for name in header:
        if name and name.strip() and not name.startswith("_c"):
            blocks[-1].append(name)
        elif blocks[-1]:
            blocks.append([])
    return [b for b in blocks if b]


def flatten_json(df: DataFrame, max_depth: int = 2) -> DataFrame:
    """Nested structs to ``a_b_c`` columns down to a depth; arrays and deeper structs as JSON text; sorted names."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    columns: dict[str, Column] = {}

    def visit(fields: StructType, path: str, name: str, depth: int) -> None:
        for f in fields.fields:
            at, called = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, StructType) and depth < max_depth:
                visit(f.dataType, f"{at}.", f"{called}_", depth + 1)
            elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
                columns[called] = F.to_json(F.col(at))
            else:
                columns[called] = F.col(at)

    visit(df.schema, "", "", 0)
    return df.select(*[columns[n].alias(n) for n in sorted(columns)])


def union_flat(frames: Sequence[DataFrame]) -> DataFrame:
    """Union over all columns any part has, in sorted order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
