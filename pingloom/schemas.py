"""Declared schemas; nothing is inferred.

The field names of the feeds, CSV headers and GTFS columns are fixed values: they must be those of the files.
"""

from __future__ import annotations

TELEMETRY_FLAT = """
    t BIGINT, vid STRING, lat DOUBLE, lon DOUBLE, heading DOUBLE, speed DOUBLE, load INT, progress DOUBLE, routeId BIGINT,
    patternId BIGINT, lastStopId BIGINT, nextStopId BIGINT, etaSeconds DOUBLE, scheduledEta DOUBLE, isDelayed BOOLEAN,
    lastStopTime BIGINT, lastStopOnTime DOUBLE"""

# both record shapes in one schema: a flat record fills the first part, a nested one the second
TELEMETRY_ANY = TELEMETRY_FLAT + """,
    did STRING, aID STRING, ts BIGINT, lt DOUBLE, ln DOUBLE, h DOUBLE, v DOUBLE, capacity INT,
    serviceState STRUCT<rID: BIGINT, status: BIGINT, patternID: BIGINT, tripID: STRING, nextStopPercentProgress: DOUBLE>,
    lastStop STRUCT<stopID: BIGINT, time: BIGINT, onTime: DOUBLE>,
    eta STRUCT<stopID: BIGINT, eta: DOUBLE, seta: DOUBLE, patternStopID: STRING>,
    schedule STRUCT<stops: ARRAY<STRUCT<id: BIGINT, psid: STRING, time: DOUBLE, type: STRING>>>"""

REQUIRED_FLAT = ("t", "vid", "lat", "lon", "speed", "routeId", "patternId", "progress")

# fixed values: telemetry names after ingest
TELEMETRY_NAMES = {
    "t": "ts_ms", "vid": "vehicle_id", "lat": "lat", "lon": "lon", "heading": "heading", "speed": "speed", "load": "passenger_load",
    "progress": "progress", "routeId": "route_id", "patternId": "pattern_id", "lastStopId": "last_stop_id", "nextStopId": "next_stop_id",
    "etaSeconds": "eta_seconds", "scheduledEta": "scheduled_eta_s", "isDelayed": "is_delayed", "lastStopTime": "last_stop_time_ms",
    "lastStopOnTime": "last_stop_on_time",
}

ARRIVALS_CSV = """
    DATE STRING, `Vehicle ID` STRING, Number STRING, Route STRING, Station STRING, ARRIVAL STRING, DEPARTURE STRING,
    `Dwell (sec)` STRING, `APC Boardings` STRING, `APC Alightings` STRING, `EPC Boardings` STRING, `EPC Alightings` STRING"""

WEATHER_CSV = "time STRING, precipitation DOUBLE, precipitation_probability DOUBLE, temperature_2m DOUBLE"

STOPS_JSON = "id STRING, name STRING, lat DOUBLE, lon DOUBLE, code STRING"

# kept columns of the GTFS text files
GTFS = {
    "routes": "route_id STRING, route_short_name STRING, route_long_name STRING",
    "stops": "stop_id STRING, stop_name STRING, stop_lat DOUBLE, stop_lon DOUBLE",
    "trips": "trip_id STRING, route_id STRING, service_id STRING, shape_id STRING",
    "stop_times": "trip_id STRING, arrival_time STRING, departure_time STRING, stop_id STRING, stop_sequence INT, shape_dist_traveled DOUBLE",
    "shapes": "shape_id STRING, shape_pt_lat DOUBLE, shape_pt_lon DOUBLE, shape_pt_sequence INT, shape_dist_traveled DOUBLE",
    "calendar": "service_id STRING, monday INT, tuesday INT, wednesday INT, thursday INT, friday INT, saturday INT, sunday INT, start_date STRING, end_date STRING",
}

# without these a table cannot be joined
GTFS_KEYS = {
    "routes": ("route_id",), "stops": ("stop_id",), "trips": ("trip_id", "route_id"), "stop_times": ("trip_id", "stop_id", "stop_sequence"),
    "shapes": ("shape_id", "shape_pt_sequence"), "calendar": ("service_id",),
}

TRIP_UPDATE = "trip_id STRING, delay INT, stop_time_update ARRAY<STRUCT<stop_id: STRING, arrival_time: BIGINT>>"
ALERT = """
    id STRING, header ARRAY<STRUCT<language: STRING, text: STRING>>, description ARRAY<STRUCT<language: STRING, text: STRING>>,
    periods ARRAY<STRUCT<start_s: BIGINT, end_s: BIGINT>>, route_ids ARRAY<STRING>"""
