"""Sliced windows against pandas and against plain Spark windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pingloom.config import Thresholds
from pingloom.operators import events, features, joins, windows
from pingloom.plans import slices

ORDER = ["ts_ms", "event_id"]


@pytest.fixture(scope="module")
def track(spark):
    """Three vehicles over ten hours; the first holds two thirds of all rows; gaps of 4, 5, 300 and 301 s occur."""
    rng = np.random.default_rng(7)
    rows = []
    for vehicle, n in ((1, 1200), (2, 300), (3, 300)):
        steps = rng.choice([4, 5, 20, 30, 60, 299, 300, 301], n, p=[0.1, 0.1, 0.3, 0.3, 0.14, 0.02, 0.02, 0.02])
        ts = 1_704_067_200_000 + np.cumsum(steps) * 1000
        for i in range(n):
            rows.append((vehicle, 10 * vehicle, int(ts[i]), 32.6 + float(rng.normal(0, 1e-3)), -85.5 + float(rng.normal(0, 1e-3)),
                         None if rng.random() < 0.1 else float(rng.integers(0, 30)), float(rng.random()), int(rng.integers(0, 4))))
    pdf = pd.DataFrame(rows, columns=["vehicle_id", "route_id", "ts_ms", "lat", "lon", "speed", "progress", "last_stop_id"])
    pdf["event_id"] = np.arange(len(pdf))
    schema = "vehicle_id long, route_id long, ts_ms long, lat double, lon double, speed double, progress double, last_stop_id long, event_id long"
    df = spark.createDataFrame(pdf, schema)
    return pdf, df.withColumn("speed", F.when(~F.isnan("speed"), F.col("speed"))).cache()


def by_id(df):
    return df.orderBy("event_id").toPandas().reset_index(drop=True)


@pytest.mark.parametrize("slice_ms", [60_000, 3_600_000])
def test_lag_fill_and_total_cross_slices(track, slice_ms):
    _, df = track
    w = Window.partitionBy("vehicle_id").orderBy(*ORDER)
    plain = df.select(
        "event_id", F.lag("speed").over(w).alias("a"), F.last("speed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b"),
        F.sum("last_stop_id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    lag = slices.lag_across(df, ["vehicle_id"], "ts_ms", ORDER, {"a": "speed"}, slice_ms)
    fill = slices.fill_across(df, ["vehicle_id"], "ts_ms", ORDER, {"b": F.col("speed")}, slice_ms)
    total = slices.running_total(df, ["vehicle_id"], F.floor(F.col("ts_ms") / slice_ms), ORDER, {"c": F.col("last_stop_id")})
    want = by_id(plain)
    for name, got in (("a", lag), ("b", fill), ("c", total)):
        pd.testing.assert_series_equal(by_id(got)[name].astype(float), want[name].astype(float))


def test_rank_in_time_is_a_permutation(track):
    pdf, df = track
    ranked = by_id(slices.rank_in_time(df, "ts_ms", ORDER))
    want = pdf.sort_values(ORDER).assign(rank=np.arange(1, len(pdf) + 1)).sort_values("event_id")["rank"].to_numpy()
    assert (ranked["rank"].to_numpy() == want).all()


def test_rolling_equals_pandas(track):
    pdf, df = track
    got = by_id(windows.rolling_time(df, "speed", [30, 180]))
    ts = pdf.assign(t=pd.to_datetime(pdf.ts_ms, unit="ms")).set_index("t")
    for seconds in (30, 180):
        grouped = ts.groupby(["vehicle_id", "route_id"])["speed"].rolling(f"{seconds}s", min_periods=1)
        np.testing.assert_allclose(got[f"speed_mean_{seconds}s"], grouped.mean().to_numpy(), rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(got[f"speed_std_{seconds}s"], grouped.std().to_numpy(), rtol=1e-6, atol=1e-6, equal_nan=True)


def test_gps_speed_guards(track):
    _, df = track
    got = by_id(windows.gps_speed(df))
    gap = got.groupby("vehicle_id").ts_ms.diff()
    assert got.gps_speed_mps[(gap < 5000) | gap.isna() | (gap > 300_000)].isna().all()
    assert got.gps_speed_mps[(gap >= 5000) & (gap <= 300_000)].notna().all()
    assert got.gps_speed_mps.max() <= 29.06


def test_one_pass_trajectory_equals_single_operators(track):
    _, df = track
    cfg = Thresholds()
    step = windows.acceleration(windows.rolling_time(windows.gps_speed(df), "gps_speed_mps"))
    step = by_id(events.idle_streaks(step, "gps_speed_mps"))
    once = by_id(features.ping_features(df, cfg))
    for column in features.PING_FEATURES:
        np.testing.assert_allclose(once[column].astype(float), step[column].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True, err_msg=column)


def test_idle_streak_seconds(track):
    _, df = track
    got = by_id(events.idle_streaks(df, "speed", idle_below=10.0))
    start, last, want = {}, {}, []
    for r in got.itertuples():
        idle = r.speed == r.speed and r.speed < 10
        key = r.vehicle_id
        if key not in last or last[key][1] != idle or r.ts_ms - last[key][0] > 300_000:
            start[key] = r.ts_ms
        last[key] = (r.ts_ms, idle)
        want.append((r.ts_ms - start[key]) / 1000 if idle else 0.0)
    np.testing.assert_allclose(got.seconds_idle, want)


def test_asof_equals_merge_asof(track, spark):
    pdf, df = track
    rng = np.random.default_rng(3)
    right = pd.DataFrame({"vehicle_id": rng.integers(1, 4, 60), "at": rng.choice(pdf.ts_ms, 60) + rng.choice([0, 1, 7000], 60)}).sort_values("at")
    for tolerance in (7_200_000, 30_000):
        for strict in (False, True):
            got = by_id(joins.asof_next(df, spark.createDataFrame(right), ["vehicle_id"], "ts_ms", "at", tolerance, "next_ms", strict=strict))
            want = pd.merge_asof(pdf.sort_values("ts_ms"), right, left_on="ts_ms", right_on="at", by="vehicle_id", direction="forward",
                                 tolerance=tolerance, allow_exact_matches=not strict).sort_values("event_id")
            np.testing.assert_array_equal(got.next_ms.fillna(-1).to_numpy(), want["at"].fillna(-1).to_numpy())
    back = by_id(joins.asof_previous(df, spark.createDataFrame(right), ["vehicle_id"], "ts_ms", "at", 60_000, "prev_ms"))
    want = pd.merge_asof(pdf.sort_values("ts_ms"), right, left_on="ts_ms", right_on="at", by="vehicle_id", tolerance=60_000).sort_values("event_id")
    np.testing.assert_array_equal(back.prev_ms.fillna(-1).to_numpy(), want["at"].fillna(-1).to_numpy())


def test_asof_at_the_borders(spark):
    left = spark.createDataFrame([(1, "a", 10_000_000)], "event_id long, k string, ts_ms long")
    cases = [(0, True, 0), (7_200_000, True, 7_200_000), (7_200_001, True, None), (0, False, None)]
    for shift, equal_allowed, want in cases:
        right = spark.createDataFrame([("a", 10_000_000 + shift)], "k string, at long")
        got = joins.asof_next(left, right, ["k"], "ts_ms", "at", 7_200_000, "next_ms", strict=not equal_allowed).first().next_ms
        assert got == (None if want is None else 10_000_000 + want)


def test_window_match_takes_the_nearest_and_the_first(spark):
    ev = spark.createDataFrame([(1, "a", 1_000_000)], "event_id long, k string, t long")
    arr = spark.createDataFrame([("a", 945_000), ("a", 990_000), ("a", 1_010_000), ("a", 1_200_000)], "k string, at long")
    assert joins.match_event_window(ev, arr, ["k"], "t", "at").first().matched_ms == 990_000
    assert joins.match_event_window(ev, arr, ["k"], "t", "at", nearest=False).first().matched_ms == 945_000


def test_dwell_groups_stay_with_their_vehicle(spark):
    rows = [(1, 1, 0, 5, 0.0, 1), (1, 1, 10_000, 6, 0.0, 2), (1, 1, 40_000, 6, 5.0, 3), (1, 1, 50_000, 7, 0.0, 4), (1, 1, 70_000, 7, 0.0, 5),
            (2, 1, 5_000, 9, 9.0, 6), (2, 1, 30_000, 9, 9.0, 7)]
    df = spark.createDataFrame(rows, "vehicle_id long, route_id long, ts_ms long, last_stop_id long, v double, event_id long")
    got = {(r.vehicle_id, r.stop_id): r.dwell_s for r in events.dwell_events(df, "v").collect()}
    assert got == {(1, 6): 30.0, (1, 7): 20.0}


def test_downsample_keeps_last_known_value(spark):
    rows = [(1, 1, 1_000, 3.0, 1), (1, 1, 50_000, None, 2), (1, 1, 61_000, 9.0, 3)]
    df = spark.createDataFrame(rows, "vehicle_id long, route_id long, ts_ms long, load double, event_id long")
    got = {r.bucket_ms: (r.load, r.event_id) for r in events.downsample_last(df).collect()}
    assert got == {0: (3.0, 2), 60_000: (9.0, 3)}


def test_fan_out_comes_after_the_shuffle(spark):
    """One row a ping meets the arrivals, whatever the number of targets; keys and times may be missing, arrivals may repeat."""
    rng = np.random.default_rng(4)
    pings = [(i, int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 40_000_000)), float(rng.random())) for i in range(200)] + [(900, None, 1, 5, 0.1), (901, 1, 1, None, 0.1)]
    arrivals = [(int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 6)), int(rng.integers(0, 40_000_000))) for _ in range(300)]
    arrivals += [*arrivals[:20], (None, 1, 1, 9), (1, 1, None, 9), (1, 1, 1, None)]
    seq = spark.createDataFrame([(r, s, s, s / 6) for r in range(3) for s in range(6)], "route_id long, stop_id long, stop_sequence long, stop_progress double")
    p = spark.createDataFrame(pings, "event_id long, vehicle_id long, route_id long, ts_ms long, progress double")
    a = spark.createDataFrame(arrivals, "vehicle_id long, route_id long, stop_id long, arrival_ms long")
    reach = 7_200_000
    got = {(r.event_id, r.target_stop_id): (r.at, r.stops_away) for r in joins.label_stops_ahead(p, a, seq, "ts_ms", "arrival_ms", reach, "at", k=3).collect()}
    want = {}
    for i, vehicle, route, ts, progress in pings:
        ahead = [s for s in range(6) if s / 6 > progress][:3]
        for away, stop in enumerate(ahead, 1):
            times = [t for v, r, s, t in arrivals if None not in (v, r, s, t, vehicle, ts) and (v, r, s) == (vehicle, route, stop) and ts <= t <= ts + reach]
            if times:
                want[i, stop] = (min(times), away)
    assert got == want and len(want) > 50
    asked = p.withColumn("targets", F.array(F.lit(0), F.lit(5), F.lit(5)).cast("array<long>"))
    multi = joins.multi_target_asof(asked, "targets", a, ["vehicle_id", "route_id"], "stop_id", "ts_ms", "arrival_ms", reach, "event_id")
    rows = {r.event_id: r.arrivals_ms for r in multi.collect()}
    assert len(rows) == len(pings) and rows[900] == rows[901] == [None] * 3 and all(r[1] == r[2] for r in rows.values())
    # the only rows multiplied are the arrivals
    assert multi._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_summaries_of_slices_are_never_broadcast(spark, tmp_path):
    """Where a slice has one row of a key, there are as many summaries as rows, however few bytes these take."""
    df = spark.createDataFrame([(v, i, i * 7_200_000, float(i % 3) if i % 4 else None) for v in (1, 2, None) for i in range(20)], "vehicle_id long, event_id long, ts_ms long, x double")
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    lag = slices.lag_across(df, ["vehicle_id"], "ts_ms", ORDER, {"a": "x"})
    fill = slices.fill_across(df, ["vehicle_id"], "ts_ms", ORDER, {"b": F.col("x")})
    for found in (lag, fill):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
    known = df.where("vehicle_id IS NOT NULL").collect()
    x = {(r.vehicle_id, r.event_id): r.x for r in known}
    assert {(r.vehicle_id, r.event_id): r.a for r in lag.where("vehicle_id IS NOT NULL").collect()} == {(v, i): x.get((v, i - 1)) for v, i in x}
    assert {(r.vehicle_id, r.event_id): r.b for r in fill.where("vehicle_id IS NOT NULL").collect()} == {(v, i): x[v, i] if x[v, i] is not None else x.get((v, i - 1)) for v, i in x}
    assert lag.count() == fill.count() == 60
