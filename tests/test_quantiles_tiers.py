"""Exact quantiles, tiers and history cells."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pingloom.functions import scalars as S
from pingloom.operators import dictionary, history, metrics, quantiles, shift, summaries, tiers
from pingloom.operators.quantiles import grouped_quantiles


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0, -1.0, 1e-9])), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p995": 0.995, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in grouped_quantiles(df, ["k"], "x", probs, "n").collect()}
    for key, part in pd.DataFrame(rows, columns=["k", "x"]).groupby("k", dropna=False):
        r = got[None if pd.isna(key) else key]
        assert r.n == len(part)
        for name, p in probs.items():
            np.testing.assert_allclose(r[name], np.quantile(part.x, p), rtol=1e-9, atol=1e-9)


def test_bins_equal_digitize(spark):
    x = pd.Series([0.0, 1, 2, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    df = spark.createDataFrame(x.to_frame("x"))
    edges = tiers.quantile_bins_fit(df, F.col("x"), 4)
    probes = [None, -1.0, 0.0, 1.9, 2.0, 2.1, 8.0, 1000.0]
    got = [r.b for r in tiers.quantile_bins_apply(spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "i int, x double"), F.col("x"), edges, "b").orderBy("i").collect()]
    e = pd.qcut(x, 4, retbins=True, duplicates="drop")[1]
    e[0], e[-1] = 0.0, np.inf
    want = [-1, -1, *[int(np.clip(np.digitize(p, e, right=True), 1, len(e) - 1) - 1) for p in probes[2:]]]
    assert got == want


def test_cell_needs_enough_observations(spark):
    for n, known in ((9, False), (10, True)):
        df = spark.createDataFrame([(1, 1, 8, 1, float(i)) for i in range(n)], "route_id int, last_stop_id int, hour_ct int, day_type int, segment_s double")
        row = history.hist_segments(df).first()
        assert (row.segment_travel_median is not None) == known and row.n == n


def test_each_tier_answers_in_turn(spark):
    config = tiers.BASELINE
    cols = "route_id long, last_stop_id long, target_stop_id long, elapsed_decile int, segment_decile int, is_stopped int, on_time_4bin int, label_s double"
    train = spark.createDataFrame([(1, 1, 1, 3, 4, 0, 2, 100.0), (1, 1, 1, 3, 4, 0, 2, 200.0), (1, 2, 1, 0, 0, 0, 0, 7.0)], cols)
    probes = [((3, 4, 0, 2), "A"), ((3, 4, 0, 1), "B"), ((3, 4, 1, 2), "C"), ((3, 9, 1, 2), "D"), ((-1, 4, 0, 2), "E"), ((9, 9, 0, 2), "F")]
    rows = [(i, 1, 1, 1, *p, None) for i, (p, _) in enumerate(probes)] + [(90, 1, 2, 1, 0, 0, 0, 0, 5.0), (91, 7, 7, 7, 0, 0, 0, 0, None)]
    test = spark.createDataFrame(rows, "i long, route_id long, last_stop_id long, target_stop_id long, elapsed_decile int, segment_decile int, is_stopped int, on_time_4bin int, s2s double")
    got = {r.i: r for r in tiers.tier_apply(test, tiers.tier_fit(train, config), config, "s2s").collect()}
    assert [got[i].tier for i in range(6)] == [t for _, t in probes]
    assert all(got[i].baseline == 150.0 for i in range(6))
    # one observation is too few for a cell; then the last resort, then nothing
    assert (got[90].tier, got[90].baseline) == ("last", 5.0) and (got[91].tier, got[91].baseline) == ("none", None)


def test_tiers_without_a_common_key(spark):
    config = tiers.TierConfig("apart", (tiers.Tier("A", ("route_id",)), tiers.Tier("B", ("stop_id",))), 1)
    train = spark.createDataFrame([(1, 5, 0, 10.0), (2, 6, 0, 20.0)], "route_id long, stop_id long, elapsed_decile int, label_s double")
    test = spark.createDataFrame([(1, 1, 6), (2, 9, 6), (3, 9, 9), (4, None, 5)], "i long, route_id long, stop_id long")
    got = {r.i: (r.tier, r.baseline) for r in tiers.tier_apply(test, tiers.tier_fit(train, config), config).collect()}
    assert got == {1: ("A", 10.0), 2: ("B", 20.0), 3: ("none", None), 4: ("B", 10.0)}


def test_coverage_adds_up(spark):
    df = spark.createDataFrame([("A",), ("A",), ("none",)], "tier string")
    rows = tiers.tier_coverage(df).collect()
    assert sum(r.n for r in rows) == 3 and abs(sum(r.pct for r in rows) - 100) < 1e-9


def test_clip_keeps_null_and_segment_wraps(spark):
    df = spark.createDataFrame([(None, 0.9, 0.1, 0.8), (5.0, 0.2, 0.6, None)], "x double, p double, t double, l double")
    rows = df.select(S.clip("x", 0.0, 1.0).alias("c"), S.segment_decile("p", "t", "l").alias("d")).collect()
    assert rows[0].c is None and rows[1].c == 1.0
    assert rows[0].d == 6 and rows[1].d == 3  # 0.2 of 0.3 left across the loop's end; 0.4 of the route


def test_metrics_edges(spark):
    df = metrics.with_errors(spark.createDataFrame([(0.0, 60.0), (100.0, 40.0), (10.0, 10.0)], "actual double, p double"), "actual", "p")
    row = metrics.regression_metrics(df).first()
    assert abs(row.mape - 30.0) < 1e-9 and row.median_ae == 60.0  # the zero actual is left out of MAPE
    strict, loose = metrics.within_thresholds(df).first(), metrics.within_thresholds(df, inclusive=True).first()
    assert abs(strict.within_60s - 1 / 3) < 1e-12 and loose.within_60s == 1.0
    crossed = spark.createDataFrame([(9.0, 5.0, 7.0, 6.0)], "a double, b double, c double, y double")
    row = metrics.quantile_eval(crossed, "a", "b", "c", "y").first()
    assert row.n_crossing == 1 and row.mean_range == 4.0 and row.coverage == 1.0


def test_ks_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    a = np.round(rng.normal(size=400), 1)
    hit = (rng.random(400) < 0.2) & (a > -0.5)
    df = spark.createDataFrame(pd.DataFrame({"x": a, "f": hit.astype(int)}))
    got = shift.ks_statistic(df, ["x"], "f").first().ks
    grid = np.unique(a)
    want = max(abs((a <= g).mean() - (a[hit] <= g).mean()) for g in grid)
    assert abs(got - want) < 1e-12


def test_no_bin_holds_a_large_share(spark):
    """A day of epoch milliseconds, latitudes of a county, kelvin, equal and extreme values: what one task orders stays small."""
    n, few = 20_000, 150
    i = F.col("id")
    df = spark.range(n).select(
        (F.lit(1_706_000_000_000) + i * 4320).cast("double").alias("ms"), (F.lit(32.5) + i * 1e-5).alias("lat"), (F.lit(270.0) + i / 700).alias("kelvin"),
        F.when(i % 2 == 0, F.lit(7.0)).otherwise(i.cast("double")).alias("half_equal"), F.pow(F.lit(10.0), i % 600 - 300).alias("scales"), (F.lit(1e15) + F.floor(i / 300)).alias("steps"))
    for c in df.columns:
        rows = df.select(F.col(c).alias("_x"), F.lit(1).cast("long").alias("_w")).withColumn("_bin", quantiles.first_bin(F.col("_x")))
        bins = quantiles.wanted_bins(rows, [], [0.1, 0.3, 0.5, 0.99], few).collect()
        assert all(b._c <= few or b._low == b._high for b in bins), (c, bins)
        got = grouped_quantiles(df, [], c, {"q": 0.3, "r": 0.5}, few=few).first()
        values = np.array([r[0] for r in df.select(c).collect()])
        np.testing.assert_allclose([got.q, got.r], np.quantile(values, [0.3, 0.5]), rtol=1e-12)


def test_quantiles_read_their_input_once(spark, tmp_path):
    """The values are written before anything is counted: the result's plan knows nothing of where they came from."""
    spark.range(500).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS x").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    plan = grouped_quantiles(df, ["k"], "x", {"q": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan


def test_cells_from_days_equal_cells_from_all_rows(spark, tmp_path):
    """Each day is summarised once, a day delivered again replaces its part, and a refit reads summaries only."""
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({"k": rng.choice(["a", "b", None], n), "day": rng.integers(0, 9, n), "x": np.round(rng.lognormal(3, 1, n), 1)})
    frame.loc[::50, "x"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    folder = str(tmp_path / "days")
    for part in (rows.where("day < 6").withColumn("x", F.when(F.col("day") == 3, F.lit(1.0)).otherwise(F.col("x"))), rows.where("day >= 6"), rows.where("day = 3")):
        summaries.write_days(summaries.daily(part, ["k"], "x", "day"), folder, "day")
    days = summaries.read_days(spark, folder)
    assert days.count() == rows.where("x IS NOT NULL").select("k", "day").distinct().count()
    probs = {"p25": 0.25, "p50": 0.5, "p90": 0.9}
    want = {r.k: r for r in grouped_quantiles(rows, ["k"], "x", probs, "n").collect()}
    got = {r.k: r for r in summaries.merged_quantiles(days, ["k"], probs).collect()}
    assert got.keys() == want.keys() and all(got[k][c] == want[k][c] for k in want for c in ("p25", "p50", "p90", "n"))
    plain = {r.k: r for r in rows.groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n")).collect()}
    for r in summaries.merged_moments(days, ["k"]).collect():
        assert r.n == plain[r.k].n and abs(r["mean"] - plain[r.k]["mean"]) < 1e-9 and abs(r["std"] - plain[r.k]["std"]) < 1e-9
    one = spark.createDataFrame([("a", 0, 1e9 + 0.1), ("a", 1, 1e9 + 0.3)], "k string, day int, x double")
    (row,) = summaries.merged_moments(summaries.daily(one, ["k"], "x", "day"), ["k"]).collect()
    assert abs(row["std"] - np.std([0.1, 0.3], ddof=1)) < 1e-6
    assert summaries.merged_moments(summaries.daily(one.limit(1), ["k"], "x", "day"), ["k"]).first()["std"] is None


def test_missing_numbers_do_not_count(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (float("inf"),)], "x double")
    row = grouped_quantiles(df, [], "x", {"q": 0.5}, "n").first()
    assert (row.q, row.n) == (3.0, 3)
    assert [r.q for r in grouped_quantiles(df.limit(0), [], "x", {"q": 0.5}).collect()] == [None]


def test_rows_of_quantiles_are_never_broadcast(spark, monkeypatch):
    """Many bins: both sides are dealt, however small the rows' file is; few bins: these are broadcast."""
    df = spark.range(4000).select((F.col("id") % 1000).alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("x", 0.5).alias("m")).collect()}
    for short, kind in ((0, "SortMergeJoin"), (1_000_000, "BuildRight")):
        monkeypatch.setattr(quantiles, "SHORT", short)
        found = grouped_quantiles(df, ["k"], "x", {"m": 0.5})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert kind in plan and "BuildLeft" not in plan and (short or "Broadcast" not in plan), plan
        assert {r.k: r.m for r in found.collect()} == want


def test_folded_cells_are_joined_with_nothing(spark):
    cells = spark.createDataFrame([(0, 1, 5, 1.0), (0, 1, 6, 2.0), (1, 1, None, 3.0), (0, 2, None, 4.0), (0, None, 5, 5.0), (1, 3, None, 6.0)], "_tier int, a int, b int, value double")
    table = dictionary.folded(cells, ["a"], [["b"], []], ["value"])
    assert "Join" not in table._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5), (3, None), (4, 5)], "a int, b int").join(table, "a", "left")
    got = {(r.a, r.b): (r.x, r.y) for r in rows.select("a", "b", dictionary.found("_dict", 0, ["b"])["value"].alias("x"), dictionary.found("_dict", 1, [])["value"].alias("y")).collect()}
    assert got == {(1, 5): (1.0, 3.0), (1, 6): (2.0, 3.0), (1, 7): (None, 3.0), (2, 5): (None, None), (3, None): (None, 6.0), (4, 5): (None, None)}
