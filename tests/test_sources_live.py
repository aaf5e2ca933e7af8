"""Readers on small files, local times, network geometry, streams and splits."""

import gzip
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pingloom import schemas
from pingloom.functions import geo as G
from pingloom.functions import scalars as S
from pingloom.functions import times as T
from pingloom.operators import clean, geometry, joins, model, network, quality, resolve, splits
from pingloom.sources import readers, writers
from pingloom.streaming import live as L


def test_telemetry_lines(spark, tmp_path):
    good = {"t": 1, "vid": "21-1", "lat": 32.6, "lon": -85.5, "speed": 65.0, "routeId": 2, "patternId": 1, "progress": 0.5}
    (tmp_path / "raw_data_1.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps({**good, "t": 2})]))
    (tmp_path / "raw_data_2.jsonl").write_text(json.dumps({"t": 3, "vid": "21-2", "lat": 1.0}))
    with gzip.open(tmp_path / "raw_data_3.jsonl.gz", "wt") as f:
        f.write(json.dumps({**good, "t": 4, "speed": 66.0}))
    rows, report = readers.read_telemetry(spark, str(tmp_path / "raw_data_*.jsonl*"))
    assert sorted(r.ts_ms for r in rows.collect()) == [1, 2, 4]
    seen = {r._file.rsplit("/", 1)[1]: (r.n_records, r.n_malformed, r.skipped) for r in report.collect()}
    assert seen == {"raw_data_1.jsonl": (2, 1, 0), "raw_data_2.jsonl": (1, 0, 1), "raw_data_3.jsonl.gz": (1, 0, 0)}
    assert clean.filter_speed(rows).count() == 2


def test_both_record_shapes(spark):
    lines = [
        {"t": 5, "vid": "a", "lat": 1.0, "lon": 2.0, "routeId": 3, "nextStopId": 4},
        {"ts": 6, "did": "b", "lt": 1.5, "ln": 2.5, "serviceState": {"rID": 7}, "eta": {"stopID": 8, "eta": 600}},
        {"ts": 7, "lt": 1.5, "ln": 2.5}, {"vid": "c", "lat": 1.0, "lon": 1.0},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "j string").select(F.from_json("j", schemas.TELEMETRY_ANY).alias("r")).select("r.*")
    got = {r.vehicle_id: r for r in readers.normalize_telemetry(df).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].ts_ms, got["a"].next_stop_id) == (5, 4)
    assert (got["b"].ts_ms, got["b"].route_id, got["b"].next_stop_id, got["b"].pattern_id, got["b"].eta_minutes) == (6, 7, 8, 0, 600.0)


def test_arrivals_with_title(spark, tmp_path):
    head = "DATE,Vehicle ID,Number,Route,Station,ARRIVAL,DEPARTURE,Dwell (sec),APC Boardings,APC Alightings,EPC Boardings,EPC Alightings"
    body = ["1/15/2026,21-1,7,R,Hub ,7:30:45,7:31:00,15,1,0,2,0", "2026-01-15,21-1,NIS,R,Hub,8:00:00,8:00:00,x,,,,", "2026-01-15,jAUnt 3,7,R,Hub,8:00:00,8:00:00,1,,,,"]
    (tmp_path / "Arrivals1.csv").write_text("\n".join(["Arrivals 2026, all", head, *body[:1]]))
    (tmp_path / "Arrivals2.csv").write_text("\n".join(["Arrivals 2026, all", head, *body[1:]]))
    raw = readers.read_arrivals(spark, str(tmp_path / "Arrivals*.csv"))
    assert raw.count() == 3
    # a record cut off after the dwell time and one without a number stay
    (tmp_path / "Short.csv").write_text("\n".join(["Arrivals, 2026", head, "2026-01-15,21-2,7,R,Hub,7:00:00,7:01:00,60", "2026-01-15,21-3,,R,Hub,7:00:00,7:01:00,60,1,1,1,1"]))
    short = readers.parse_arrivals(readers.read_arrivals(spark, str(tmp_path / "Short.csv"))).orderBy("vehicle_id").collect()
    assert [(r.vehicle_id, r.dwell_s, r.boardings) for r in short] == [("21-2", 60.0, 0.0), ("21-3", 60.0, 2.0)]
    kinds = readers.titled_lines(spark, str(tmp_path / "*.csv"), schemas.ARRIVALS_CSV, "DATE,").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"title": 3, "header": 3, "record": 5}
    row = readers.parse_arrivals(raw).collect()
    assert len(row) == 1 and row[0].station == "Hub" and row[0].arrival_ms == 1_768_483_845_000 and row[0].boardings == 3.0


@pytest.mark.parametrize(("day", "clock", "want"), [
    ("2025-11-02", "1:30:00", None), ("2025-03-09", "2:30:00", "2025-03-09 08:00:00"), ("3/9/2025", "1:30:00", "2025-03-09 07:30:00"),
    ("2025-01-05", "25:10:00", "2025-01-06 07:10:00"), ("2025-11-02", "0:30:00", "2025-11-02 05:30:00"), ("2025-11-02", "2:00:00", "2025-11-02 08:00:00"),
])
def test_local_times(spark, day, clock, want):
    df = spark.createDataFrame([(day, clock)], "d string, c string")
    got = df.select(F.date_format(F.timestamp_millis(T.local_text_to_utc_ms("d", "c", "US/Central")), "yyyy-MM-dd HH:mm:ss").alias("t")).first().t
    assert got == want


def test_gtfs_folder(spark, tmp_path):
    for name, schema in schemas.GTFS.items():
        columns = [p.strip().split(" ")[0] for p in schema.split(",")]
        cells = {"route_id": "215_202", "trip_id": "t", "stop_id": "5", "shape_id": "s"}
        text = ",".join(columns) + "\n" + ",".join(f'"{cells.get(c, 1)}"' for c in columns) + "\n"
        (tmp_path / f"{name}.txt").write_bytes(("﻿" + text).encode())
    got = readers.read_gtfs(spark, str(tmp_path))
    assert got["routes"].first().route_id_num == 215 and got["stop_times"].first().stop_sequence == 1 and got["stops"].first().stop_id == "5"


def test_route_ids(spark):
    df = spark.createDataFrame([("215_202_201",), ("227_",), ("_32",), ("9",), (None,)], "r string")
    assert [r.n for r in df.select(S.route_id_num("r").alias("n")).collect()] == [215, 227, None, 9, None]


def test_union_flat_and_service_days(spark, tmp_path):
    a = readers.flatten_json(spark.createDataFrame([(1, (2, (3, (4,))))], "z int, a struct<b int, c struct<d int, e struct<f int>>>"))
    assert a.columns == ["a_b", "a_c_d", "a_c_e", "z"] and a.first().a_c_e == '{"f":4}'
    assert readers.union_flat([a, spark.createDataFrame([(1,)], "q int")]).count() == 2
    day = spark.createDataFrame([(5 * 3_600_000,), (6 * 3_600_000,), (30 * 3_600_000,)], "ts_ms long")
    counts = {r.service_day: (r.n, r.resume_day) for r in writers.split_by_service_day(day, str(tmp_path / "d")).collect()}
    assert counts == {-1: (1, 2), 0: (1, 2), 1: (1, 2)}


def test_lookup_must_be_unique(spark):
    df, dim = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        joins.lookup_left(df, dim, ["k"]).collect()
    with pytest.raises(Exception, match="lacks a row"):
        writers.patch_columns(dim.limit(1), spark.createDataFrame([(9, 9)], "k int, v int"), ["v"], ["k"]).collect()


def test_canonical_shape_tie(spark):
    st = spark.createDataFrame([(1, 7, "t1"), (1, 7, "t1"), (1, 5, "t2"), (1, 9, "t3")], "route_id int, shape_id int, trip_id string")
    assert network.canonical_shape(st).first().shape_id == 5


def test_stops_ahead_ranks(spark):
    seq = spark.createDataFrame([(1, s, s, s / 10) for s in range(1, 11)], "route_id int, stop_id int, stop_sequence int, stop_progress double")
    got = joins.explode_stops_ahead(spark.createDataFrame([(1, 0.05), (1, 0.95)], "route_id int, progress double"), seq).collect()
    first = sorted(r.stops_away for r in got if r.progress == 0.05)
    assert first == list(range(1, 9)) and [r.target_stop_id for r in got if r.progress == 0.95] == [10]


def test_snapping_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    shape = [(1, i, 32.5 + 0.2 * rng.random(), -85.6 + 0.2 * rng.random(), float(i)) for i in range(40)] + [(2, 0, 32.55, -85.5, 0.0), (2, 1, 32.55, -85.5, 1.0)]
    pts = [(i, 1 + i % 2, 32.5 + 0.2 * rng.random(), -85.6 + 0.2 * rng.random()) for i in range(120)] + [(500, 1, 32.5, -85.6), (501, 1, 32.7, -85.4)]
    # far away, on the other side, at the poles and the globe's edges, on a vertex, and off the globe
    far = [(33.9, -84.0), (-32.5, 94.5), (90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (12.0, -180.0), (32.55, -85.5), (95.0, 10.0), (32.6, -445.0)]
    pts += [(600 + 2 * k + s, 1 + s, *at) for k, at in enumerate(far) for s in (0, 1)]
    segments = geometry.shape_segments(spark.createDataFrame(shape, "shape_id int, seq int, lat double, lon double, dist double"))
    points = spark.createDataFrame(pts, "id int, shape_id int, lat double, lon double")
    snapped = {r.id: r for r in geometry.snap_to_shape(points, segments, ["id", "shape_id"]).collect()}
    placed = {r.id: r for r in geometry.project_onto_polyline(points, segments, ["id", "shape_id"]).collect()}
    assert len(snapped) == len(placed) == len(pts)

    def chord(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2

    for i, s, lat, lon in pts:
        line = [p for p in shape if p[0] == s]
        assert snapped[i].seq == min(line, key=lambda p: (chord(lat, lon, p[2], p[3]), p[1]))[1]
        best = None
        for p, q in zip(line, line[1:], strict=False):
            dy, dx = q[2] - p[2], q[3] - p[3]
            n = dx * dx + dy * dy
            t = 0.0 if n == 0 else min(1, max(0, ((lon - p[3]) * dx + (lat - p[2]) * dy) / n))
            d = math.hypot(lat - p[2] - t * dy, lon - p[3] - t * dx)
            best = d if best is None else min(best, d)
        assert abs(placed[i].distance - best) < 1e-12


def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(256).selectExpr("id div 16 AS x", "id % 16 AS y").withColumn("d", geometry.hilbert(F.col("x"), F.col("y"), 4))
    path = [(r.x, r.y) for r in sorted(cells.collect(), key=lambda r: r.d)]
    assert sorted(r.d for r in cells.collect()) == list(range(256))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_search_measures_few_pieces(spark):
    """For places in the area and anywhere else, on a shape that winds: its pieces are compared through a fifteenth as many boxes."""
    for n in (400, 6400):
        turn = np.arange(n) / 40
        line = [(1, i, 32.6 + 0.0001 * i * math.sin(t), -85.5 + 0.0001 * i * math.cos(t), float(i)) for i, t in enumerate(turn)]
        segments = geometry.shape_segments(spark.createDataFrame(line, "shape_id int, seq int, lat double, lon double, dist double"))
        rng = np.random.default_rng(n)
        lat, lon = np.r_[32.6 + 0.2 * rng.normal(size=920), rng.uniform(-90, 90, 80)], np.r_[-85.5 + 0.2 * rng.normal(size=920), rng.uniform(-180, 180, 80)]
        for kind in (geometry.Vertices, geometry.Segments):
            pieces = geometry.along_curve(segments.where("NOT is_last"), kind.ends).orderBy("_at").toPandas()
            shape, seq = kind(pieces), pieces["seq"].to_numpy()
            assert sum(len(b[0]) for b in shape.boxes[1:]) < n / 14 + 2
            best, measured = geometry.search(shape, seq, lat, lon)
            assert measured.mean() < 100 and measured.max() <= 640
            for k in range(0, 1000, 7):
                every = shape.measure(np.full(len(seq), lat[k]), np.full(len(seq), lon[k]), np.arange(len(seq)))
                assert every[best[k]] == every.min()


def test_points_without_place_or_shape_stay(spark):
    segments = geometry.shape_segments(spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 1.0, 9.0), (2, 0, None, 1.0, 0.0)], "shape_id int, seq int, lat double, lon double, dist double"))
    rows = [(1, 1, 0.1, 0.9), (2, 1, None, 0.9), (3, None, 0.1, 0.9), (4, 7, 0.1, 0.9), (5, 2, 0.1, 0.9), (1, 1, 0.1, 0.9)]
    points = spark.createDataFrame(rows, "id int, shape_id int, lat double, lon double")
    got = sorted((r.id, r.seq) for r in geometry.project_onto_polyline(points, segments, ["id", "shape_id"]).collect())
    assert got == [(1, 0), (1, 0), (2, None), (3, None), (4, None), (5, None)]
    assert geometry.snap_to_shape(points.limit(0), segments, ["id", "shape_id"]).collect() == []
    assert {r.seq for r in geometry.snap_to_shape(points, segments.limit(0), ["id", "shape_id"]).collect()} == {None}


def test_route_distance_choices(spark):
    cols = "id int, shape_id int, along double, off double, stop_dist double, shape_length double"
    rows = [
        (1, 1, 2.0, 0.05, 5.0, 10.0), (1, 2, 4.0, 0.09, 5.0, 10.0),  # two close: the shorter way
        (2, 1, 2.0, 0.15, 5.0, 10.0), (2, 2, 4.0, 0.18, 5.0, 10.0),  # none close: the closer shape
        (3, 1, 5.05, 0.01, 5.0, 10.0),  # just past
        (4, 1, 9.5, 0.01, 5.0, 10.0),  # wrapped by more than five miles: no answer
        (5, 1, 5.5, 0.01, 5.0, 5.2),  # wrapped
        (6, 1, 1.0, 0.25, 5.0, 10.0),  # too far from the shape
    ]
    got = {r.id: r.route_distance for r in geometry.route_distance_multi(spark.createDataFrame(rows, cols), ["id"]).collect()}
    assert got[1] == 1.0 and got[2] == 3.0 and got[3] == 0.0 and got[4] is None and abs(got[5] - 4.7) < 1e-12 and 6 not in got


def test_contained_names(spark):
    d = spark.createDataFrame([("Eagles West", 5), ("Eagles West", 4), ("Go", 7), ("-", 1), ("Main & 3rd Street North", 9)], "entry string, id int")
    n = spark.createDataFrame([("Eagles Westgate",), ("undergo it",), ("3rd street",), ("z",), ("--",), ("wes",), (None,)], "name string")
    got = {r.name: (r.id, r.match_type) for r in resolve.map_cascade(n, "name", d, "entry", "id").collect()}
    assert got["Eagles Westgate"] == (4, "contains") and got["undergo it"] == (7, "contains") and got["3rd street"] == (9, "contains") and got["wes"] == (4, "contains")
    assert got["z"] == (None, "unmatched") and got["--"][1] in ("unmatched", "normalized")
    entries = [f"{a} {b}" for a in ("oak", "elm", "ash", "fir", "yew") for b in ("north road", "south lane", "mill pond", "high cross")]
    names = [f"old {e}" for e in entries] + ["mill", "oak north", "pond gate"]
    left, right = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((names, "_norm"), (entries, "_dict")))
    pairs = {(r[0], r[1]) for r in resolve.containment_candidates(right, "_dict", left, "_norm").collect()}
    assert {(e, n) for e in entries for n in names if e in n} <= pairs and len(pairs) < len(entries) * 8


def test_wide_net_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 9))))
    entries, names = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    left, right = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((names, "_l"), (entries, "_r")))
    score = {(a, b): 1 - distance(a, b) / max(len(a), len(b)) for a in names for b in entries}
    for cutoff in (0.3, 0.5, 0.65):
        got = {}
        for r in resolve.nearest_entries(left, right, cutoff, 3).collect():
            got.setdefault(r[0], []).append((-round(r[2], 9), r[1]))
        for a in names:
            want = sorted((-round(score[a, b], 9), b) for b in entries if score[a, b] >= cutoff - 1e-12)
            assert sorted(got.get(a, []))[:3] == want[:3]
    met = {(r[0], r[1]) for r in resolve.letter_candidates(left, right, 0.4).collect()}
    assert {p for p, v in score.items() if v >= 0.4} <= met and len(met) < len(score) / 2


def test_fuzzy_finds_every_pair(spark):
    names = ["Student Center", "student center", "Studnt Centre", "Hub", "Hb", "Village Hall", "Libary North", "zzz"]
    entries = [("Student Center", 1), ("Hub", 2), ("Village Hall West", 3), ("Library North", 4)]
    n, d = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(entries, "entry string, id long")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    got = {r.name: r for r in resolve.fuzzy_match(n, "name", d, "entry", "id").collect()}
    for name in names:
        best = max(((1 - lev(name.lower(), e.lower()) / max(len(name), len(e)), e) for e, _ in entries))
        if best[0] >= 0.65:
            assert got[name].alternatives[0] == best[1] and abs(got[name].score - best[0]) < 1e-12
        else:
            assert got[name].match_type == "unmatched" and got[name].entry_id is None
    assert got["Student Center"].match_type == "exact" and got["student center"].match_type == "case_insensitive"
    manual = spark.createDataFrame([("zzz", 4)], "name string, entry_id long")
    assert {r.name: r for r in resolve.fuzzy_match(n, "name", d, "entry", "id", overrides=manual).collect()}["zzz"].entry_id == 4


def test_stream_keeps_state_across_files(spark, tmp_path):
    schema = "vehicle_id long, route_id long, event_id long, ts_ms long, speed double, progress double, eta_s double"
    first = [(1, 1, 1, 0, 10.0, 0.1, 100.0), (1, 1, 2, 40_000, 0.0, 0.2, 110.0)]
    second = [(1, 1, 3, 80_000, 20.0, 0.3, 300.0), (1, 2, 4, 100_000, 5.0, 0.4, 50.0)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"f{i}"))
    stream = lambda: L.telemetry_stream(spark, str(tmp_path / "f*"), schema, max_files=1)
    got = {r.event_id: r for r in L.run_available(L.history_state(stream())).collect()}
    assert got[1].speed_rolling_mean == 0.0 and got[2].speed_rolling_mean == 5.0
    assert got[3].speed_rolling_mean == 10.0 and abs(got[3].progress_rate - 0.2 / 80) < 1e-12 and got[3].acceleration == 20.0
    smooth = {r.event_id: r.smoothed_s for r in L.run_available(L.smooth_state(stream())).collect()}
    assert smooth[1] == 100.0 and abs(smooth[2] - 103.0) < 1e-9
    assert abs(smooth[3] - 133.0) < 1e-9  # a jump bypasses the average, then may rise by 30 only
    assert smooth[4] == 50.0  # a new route starts afresh


def test_history_has_no_row_limit_and_smoothing_no_restart(spark, tmp_path):
    schema = "vehicle_id long, route_id long, event_id long, ts_ms long, speed double, progress double, eta_s double"
    rows = [(1, 1, i, i * 50, float(i), 0.0, 100.0 + i % 7) for i in range(1200)]  # 1200 packets in a minute
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "f"))
    got = {r.event_id: r for r in L.run_available(L.history_state(L.telemetry_stream(spark, str(tmp_path / "f"), schema))).collect()}
    assert len(got) == 1200 and got[1199].speed_rolling_mean == pytest.approx(599.5) and got[1199].speed_rolling_min == 0.0
    want, last = {}, None
    for r in rows:
        last = r[6] if last is None or abs(r[6] - last) > 60 else 0.3 * r[6] + 0.7 * last
        want[r[2]] = last
    smooth = {r.event_id: r.smoothed_s for r in L.smooth_batch(spark.createDataFrame(rows, schema)).collect()}
    assert smooth == pytest.approx(want)
    (tmp_path / "none").mkdir()
    assert L.run_available(L.telemetry_stream(spark, str(tmp_path / "none"), schema)).count() == 0


def test_eta_texts_and_order(spark):
    df = spark.createDataFrame([(59.0,), (60.0,), (90.0,)], "s double")
    assert [r.t for r in df.select(S.eta_text("s").alias("t")).collect()] == ["< 1 min", "1 min", "2 min"]
    row = spark.createDataFrame([([100.0, 90.0, 5000.0],)], "e array<double>").select(L.order_etas(F.col("e")).alias("o")).first()
    assert row.o == [100.0, 130.0, 3600.0]


def test_haversine_identity(spark):
    row = spark.createDataFrame([(32.6, -85.5)], "a double, b double").select(
        G.haversine("a", "b", "a", "b").alias("z"), G.haversine("a", "b", F.lit(33.6), F.lit(-85.5)).alias("d")).first()
    assert row.z == 0.0 and abs(row.d - 111_194.9) < 1


def test_splits_are_disjoint_and_repeatable(spark):
    df = spark.range(1000).withColumn("ts_ms", F.col("id") * 600_000)
    cut = splits.ratio_time_split(df, "ts_ms", ["ts_ms", "id"]).groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    got = {r.split: (r.n, r.a, r.b) for r in cut.collect()}
    assert got == {"train": (700, 0, 699), "val": (150, 700, 849), "test": (150, 850, 999)}
    parts = splits.random_split(df, ["id"])
    again = splits.random_split(df.repartition(7), ["id"])
    assert parts.join(again.withColumnRenamed("split", "s2"), "id").where("split <> s2").count() == 0
    folds = splits.ts_cv_folds(df, "ts_ms", ["ts_ms", "id"], 4)
    assert [r.n for r in folds.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [200] * 5


def test_invariants_fail_fast(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "p double")
    quality.assert_invariants(df.where("p < 1"), {"unit": F.col("p").between(0, 1)})
    with pytest.raises(AssertionError, match="unit"):
        quality.assert_invariants(df, {"unit": F.col("p").between(0, 1)})


def test_model_beats_the_mean(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), None if i % 9 == 0 else float(z), float(10 * x + (5 if z > 0.5 else 0))) for i, (x, z) in enumerate(rng.random((600, 2)))]
    df = spark.createDataFrame(rows, "i long, x double, z double, y double")
    gbt = model.fit_gbt(df, ["x", "z"], "y", trees=8, depth=3)
    scored = model.score(df.withColumn("baseline", F.lit(0.0)), gbt, ["x", "z"])
    err = scored.agg(F.avg(F.abs(F.col("predicted") - F.col("y")))).first()[0]
    spread = df.agg(F.stddev("y")).first()[0]
    assert err < spread / 3
    assert model.feature_importance(spark, gbt, ["x", "z"]).first().feature == "x"


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("alpha", [0.3, 0.002])
def test_parallel_fold_equals_one_pass(spark, many_ranges, alpha):
    """A vehicle that holds most rows is cut into many ranges; with a slow average what they hand over takes several rounds to settle."""
    from pingloom.streaming.processors import Smoothing

    rng = np.random.default_rng(9)
    rows = [(1, 3, "t", i, i * 1000, float(rng.random()), float(rng.uniform(0, 400))) for i in range(900)]
    rows += [(2 + i % 3, i % 2, None if i % 5 else "u", 5000 + i, int(rng.integers(0, 900_000)), float(rng.random()), float(rng.uniform(0, 4000))) for i in range(300)]
    rows += [(None, 1, "t", 9000 + i, i, 0.5, 5.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "vehicle_id long, route_id long, trip_id string, event_id long, ts_ms long, progress double, eta_s double").repartition(5)
    got = {r.event_id: r.smoothed_s for r in L.smooth_state_batch(df, alpha=alpha, bypass_s=390.0).collect()}
    step, state, want = Smoothing(alpha, 390.0, 30.0).step, {}, {}
    for v, route, trip, event, _, progress, eta in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[4], r[3])):
        state[v] = step(state.get(v) if v is not None else None, route, trip, progress, eta)
        want[event] = state[v][3]
    assert got == want
    last = {r.vehicle_id: (r.route_id, r.trip_id, r.progress, r.smoothed) for r in L.last_states(L.smooth_state_batch(df, alpha=alpha, bypass_s=390.0)).collect()}
    assert last == {v: s for v, s in state.items() if v is not None}
    assert L.smooth_batch(df.limit(0)).collect() == []


def test_silence_is_told_by_the_packets_of_others(spark, tmp_path):
    minute, start = 60_000, 1_700_000_040_000
    at = lambda *rows: [(v, start + m * minute) for v, m in rows]
    first, second, third = at((1, 0), (2, 0), (3, 0), (1, 5), (None, 0)), at((2, 20), (1, 21), (2, 21)), at((2, 40))
    told = lambda frame: sorted((r.vehicle_id, (r.last_ms - start) // minute, (r.silent_ms - start) // minute) for r in frame.collect())
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, "vehicle_id long, ts_ms long").coalesce(1).write.json(str(tmp_path / f"w{k}"))
        (part,) = (tmp_path / f"w{k}").glob("part-*.json")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(part.read_text())
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = L.telemetry_stream(spark, str(tmp_path / "in"), "vehicle_id long, ts_ms long", 1)
    got = told(L.run_available(L.silent_vehicles(stream, 10 * minute), folder=str(tmp_path)))
    # vehicle 1 falls silent twice, the second time for good; vehicle 3 at once; vehicle 2's last packet is too recent to tell
    assert got == [(1, 5, 15), (1, 21, 31), (2, 0, 10), (2, 21, 31), (3, 0, 10)]
    every = spark.createDataFrame([*first, *second, *third], "vehicle_id long, ts_ms long")
    assert told(L.silent_vehicles_batch(every, 10 * minute, F.lit(start + 40 * minute))) == got


def test_services_of_long_ranges_meet_only_the_days_seen(spark):
    from pingloom.operators import network

    week = ", ".join(f"{d} int" for d in network.WEEKDAYS)
    rows = [(1, *[1] * 7, -10 ** 12, 10 ** 12), (1, *[1] * 7, -10 ** 12, 10 ** 12), (2, *[0] * 7, 0, 10 ** 12), (3, *[1] * 7, 5, 4), (4, *[1] * 7, None, 9), (5, 0, 0, 0, 1, 0, 0, 0, 0, 7)]
    calendar = spark.createDataFrame(rows, f"service_id long, {week}, start_day long, end_day long")
    days = spark.createDataFrame([(0,), (0,), (7,), (9,), (None,)], "day long")  # days 0 and 7 are Thursdays
    assert sorted(map(tuple, network.services_by_day(days, calendar).collect())) == [(0, 1), (0, 1), (0, 5), (7, 1), (7, 1), (7, 5), (9, 1), (9, 1)]


def test_records_are_counted_without_their_columns(spark, tmp_path):
    from pingloom import schemas

    whole = "{" + ", ".join(f'"{c}": 1' for c in schemas.REQUIRED_FLAT if c != "vid") + ', "vid": "7"}'
    (tmp_path / "a.json").write_text(f'{whole}\n{{"t": 1, "vi\n{whole}\n')
    (tmp_path / "b.json").write_text('{"t": 1}\n')
    rows, report = readers.read_telemetry(spark, str(tmp_path))
    assert rows.count() == 2
    assert sorted(tuple(r) for r in report.select("n_records", "n_malformed", "skipped").collect()) == [(1, 0, 1), (2, 1, 0)]


def test_trees_are_grown_on_parts_of_bounded_size(spark, monkeypatch):
    from pingloom.operators import model

    parts = []
    fit = model.GBTRegressor.fit

    def noted(self, df, *args):
        parts.extend(df.rdd.glom().map(len).collect())
        return fit(self, df, *args)

    monkeypatch.setattr(model, "ROWS_A_PART", 20, raising=False)
    monkeypatch.setattr(model.GBTRegressor, "fit", noted)
    rows = spark.range(400).selectExpr("id % 7 AS a", "nullif(id % 5, 0) AS b", "cast(id % 7 AS double) AS y", "id % 10 = 0 AS held").coalesce(1)
    fitted = model.fit_gbt(rows, ["a", "b"], "y", "held", trees=2, depth=2)
    assert sum(parts) == 400 and max(parts) <= 40
    assert len(fitted.stages) == 3 and fitted.transform(model.with_missing_flags(rows, ["a", "b"])).count() == 400


def test_ranges_that_one_task_holds_have_bounded_size(spark):
    from pingloom.plans.slices import in_ranges

    cut = in_ranges(spark.range(1000), ["id"], "r", rows=100).groupBy("r").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("r").collect()
    assert len(cut) == 10 and max(r["n"] for r in cut) < 300 and sum(r["n"] for r in cut) == 1000
    assert all(x["b"] < y["a"] for x, y in zip(cut, cut[1:], strict=False))


def test_the_fold_over_many_small_ranges_equals_one(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id % 4 AS vehicle_id", "id AS event_id", "id * 1000 AS ts_ms", "cast((id * 37) % 101 AS double) AS eta_s", "id % 2 AS route_id", "cast(id % 9 AS double) AS progress")
    told = lambda: sorted(map(tuple, L.smooth_state_batch(rows).select("vehicle_id", "event_id", "smoothed_s").collect()))
    whole = told()
    monkeypatch.setattr(L, "FOLD_ROWS", 20)
    assert len(whole) == 300 and told() == whole


def test_short_windows_of_the_history_equal_rolling_ones(monkeypatch):
    import numpy as np

    from pingloom.streaming import processors

    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 200_000, 300))
    v, p = rng.uniform(0, 3, 300), rng.uniform(0, 1, 300)
    first = np.searchsorted(t, t - 9_000, "left")
    own = processors.HistoryProcessor(9_000, 3_000, None)
    short = own._features(t, v, p, first)
    monkeypatch.setattr(processors, "SHORT", 0)
    rolling = own._features(t, v, p, first)
    assert (first < np.arange(300)).any()
    for name, x in short.items():
        np.testing.assert_allclose(x, rolling[name], rtol=1e-9, atol=1e-12)
    # a missing speed is left out of its windows, as before
    v[10] = np.nan
    monkeypatch.setattr(processors, "SHORT", 64)
    assert np.isfinite(own._features(t, v, p, first)["speed_rolling_mean"][11:]).all()


def test_search_measures_a_bounded_number_of_pairs(monkeypatch):
    """Many parallel pieces far from all places: what is measured at once stays within the bound, and the result is brute force's."""
    rng = np.random.default_rng(5)
    k = np.arange(6000)
    ends = pd.DataFrame({"lat1": k % 20 / 100, "lon1": k // 20 * 1e-5, "lat2": k % 20 / 100 + 0.01, "lon2": k // 20 * 1e-5})
    lat, lon = rng.uniform(-3, 3, 400), rng.uniform(-1, 1, 400)
    monkeypatch.setattr(geometry, "PAIRS", 8_192)
    for kind in (geometry.Segments, geometry.Vertices):
        shape, seen = kind(ends[list(kind.ends)]), []
        measure = shape.measure
        shape.measure = lambda a, b, piece: seen.append(len(piece)) or measure(a, b, piece)  # noqa: B023
        found, measured = geometry.search(shape, k, lat, lon)
        one = int(measured.max()) * geometry.FAN  # of a single place, which isn't cut
        assert max(seen) <= max(8_192, one) and sum(measured) > 8_192
        want = [int(np.argmin(measure(np.full(6000, a), np.full(6000, b), k))) for a, b in zip(lat, lon, strict=True)]
        assert found.tolist() == want
    assert [len(x) for x in geometry.search(shape, k, lat[:0], lon[:0])] == [0, 0]


def test_backfill_has_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_A_PART", 25)
    rows = spark.range(200).select(F.when(F.col("id") % 10 != 0, F.col("id") % 40).alias("trip_id"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("route_id"))
    trips = spark.range(30).select(F.col("id").alias("trip_id"), (F.col("id") + 1000).alias("route_id"))
    out = joins.backfill_route(rows, trips)
    assert out.rdd.getNumPartitions() == 10
    want = {i: i if i % 3 == 0 else None if i % 10 == 0 or i % 40 >= 30 else i % 40 + 1000 for i in range(200)}
    assert {r.id: r.route_id for r in out.collect()} == want


def test_rows_of_the_fit_are_split_once(spark, monkeypatch):
    """What is fitted and what is held out come from one written split, with the rows the split gives."""
    from types import SimpleNamespace

    from pingloom.catalog import model as catalog
    from pingloom.operators import splits

    seen = []
    monkeypatch.setattr(catalog.model, "fit_gbt", lambda train, *a, **k: seen.append(train))
    lines = [(i % 40 if i % 13 else None, i, i % 7, i % 5, i % 3, float(i), float(i % 11), i % 90 + 0.5, float(i % 50), i % 4, i % 24, None if i % 17 == 0 else float(i)) for i in range(300)] * 2
    df = spark.createDataFrame(lines, "order_id long, part_id long, supp_id long, line int, route_id long, actual double, baseline double, distance_m double, speed double, stops_away int, hour long, schedule_eta double")
    _, held = catalog.fitted(SimpleNamespace(predictions=df))
    for part in (seen[0], held):
        assert "md5" not in part._jdf.queryExecution().optimizedPlan().toString()
    want = splits.random_split(catalog.rows(SimpleNamespace(predictions=df)), ["order_id", "part_id", "supp_id", "line"])
    order = lambda found: sorted(map(str, found))
    assert order(seen[0].drop("is_val").collect()) == order(want.where("split <> 'test'").collect())
    assert order(held.collect()) == order(want.where("split = 'test'").collect())


def test_stop_times_are_read_once_for_sequences(spark, tmp_path):
    """Sequences and lengths come from one aggregation; rows without a stop still count for the length."""
    from pingloom.operators.network import canonical_shape, stop_sequences

    path = str(tmp_path / "times")
    rows = [(1, 10, 5, 1, 7, 2.0), (1, 10, 5, 2, 8, 4.0), (1, 10, 5, 3, None, 9.0), (2, 10, 5, 1, 7, 1.0), (2, 10, 5, 1, 7, 1.0), (3, 10, 6, 1, 9, 50.0), (4, 11, 7, 1, 7, 0.0), (5, None, 7, 1, 7, 3.0)]
    spark.createDataFrame(rows, "trip_id long, route_id long, shape_id long, stop_sequence long, stop_id long, shape_dist double").write.parquet(path)
    times = spark.read.parquet(path)
    found = stop_sequences(times, canonical_shape(times))
    assert path not in found._jdf.queryExecution().toString()
    got = sorted((r.route_id, r.stop_id or 0, r.stop_sequence, r.shape_dist, r.max_dist, r.stop_progress) for r in found.collect())
    assert got == [(10, 0, 3, 9.0, 9.0, 1.0), (10, 7, 1, 2.0, 9.0, 2 / 9), (10, 8, 2, 4.0, 9.0, 4 / 9), (11, 7, 1, 0.0, 0.0, None)]
