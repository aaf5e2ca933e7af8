"""Metrics, slices, shift diagnostics and splits (V*, D*, P*)."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import near, query, rounded
from pingloom.functions import scalars as S
from pingloom.functions.times import epoch_day
from pingloom.operators import events, joins, metrics, quality, shift, splits
from pingloom.operators.quantiles import grouped_quantiles
from pingloom.plans.stages import materialize

M = "round(avg(abs_err), 5) AS mae, round(sqrt(avg(err * err)), 5) AS rmse, round(avg(CASE WHEN actual > 0 THEN abs_err / actual END) * 100, 5) AS mape, round(stddev_pop(abs_err), 5) AS std_ae, count(*) AS n"
DAYPART = "CASE WHEN hour < 6 THEN 'evening' WHEN hour < 11 THEN 'morning' WHEN hour < 14 THEN 'midday' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END"
STOPS = "CASE WHEN stops_away <= 1 THEN '1' WHEN stops_away <= 3 THEN '2-3' WHEN stops_away <= 6 THEN '4-6' ELSE '7+' END"


def sliced(t):
    return t.eta.withColumn("tod", S.time_of_day("hour")).withColumn("stops", S.stops_bucket("stops_away"))


@query("v1_regression_metrics", f"SELECT {M}, round(median(abs_err), 6) AS median_ae FROM eta")
def _(t):
    return rounded(metrics.regression_metrics(t.eta), 5, median_ae=6)


@query("v1_metrics_by_route", f"SELECT route_id, {M}, round(median(abs_err), 6) AS median_ae FROM eta GROUP BY route_id")
def _(t):
    return rounded(metrics.regression_metrics(t.eta, ["route_id"]), 5, median_ae=6)


@query("v2_sliced_metrics", f"""
    WITH x AS (SELECT *, {DAYPART} AS tod, {STOPS} AS stops FROM eta)
    SELECT 'overall' AS dimension, 'all' AS slice, {M} FROM x UNION ALL SELECT 'route_id', CAST(route_id AS VARCHAR), {M} FROM x GROUP BY route_id
    UNION ALL SELECT 'tod', tod, {M} FROM x GROUP BY tod UNION ALL SELECT 'stops', stops, {M} FROM x GROUP BY stops""")
def _(t):
    return rounded(metrics.sliced_metrics(sliced(t), ["route_id", "tod", "stops"]), 5)


@query("v2_distance_quartiles", f"""
    WITH q AS (SELECT quantile_cont(distance_m, [0.25, 0.5, 0.75]) AS q FROM eta)
    SELECT CASE WHEN distance_m <= q[1] THEN 'Q1' WHEN distance_m <= q[2] THEN 'Q2' WHEN distance_m <= q[3] THEN 'Q3' ELSE 'Q4' END AS quartile, {M} FROM eta, q GROUP BY 1""")
def _(t):
    cut = grouped_quantiles(t.eta, [], "distance_m", {"a": 0.25, "b": 0.5, "c": 0.75}).select(F.struct("a", "b", "c").alias("c")).scalar()
    d = F.col("distance_m")
    quartile = F.when(d <= cut["a"], "Q1").when(d <= cut["b"], "Q2").when(d <= cut["c"], "Q3").otherwise("Q4")
    return rounded(t.eta.withColumn("quartile", quartile).groupBy("quartile").agg(*metrics.error_columns()), 5)


@query("v3_directional", """
    SELECT round(avg(CASE WHEN err > 0 THEN 1 ELSE 0 END), 8) AS overestimate_rate, round(avg(CASE WHEN err < 0 THEN 1 ELSE 0 END), 8) AS underestimate_rate,
           round(avg(abs_err) FILTER (err > 0), 5) AS overestimate_mae, round(avg(abs_err) FILTER (err < 0), 5) AS underestimate_mae,
           round(avg(err) FILTER (err > 0), 5) AS overestimate_mean, round(avg(err) FILTER (err < 0), 5) AS underestimate_mean FROM eta""")
def _(t):
    return rounded(metrics.directional(t.eta), 5, overestimate_rate=8, underestimate_rate=8)


LIMITS, TAILS = (30, 60, 90, 120, 180, 300), (300, 600, 900)


@query("v4_within_thresholds", "SELECT " + ", ".join([f"round(avg(CASE WHEN abs_err < {x} THEN 1 ELSE 0 END), 8) AS within_{x}s" for x in LIMITS] + [f"round(avg(CASE WHEN abs_err > {x} THEN 1 ELSE 0 END), 8) AS tail_{x}s" for x in TAILS]) + " FROM eta")
def _(t):
    return rounded(metrics.within_thresholds(t.eta), 8)


@query("v4_within_inclusive", "SELECT " + ", ".join([f"round(avg(CASE WHEN abs_err <= {x} THEN 1 ELSE 0 END), 8) AS within_{x}s" for x in LIMITS] + [f"round(avg(CASE WHEN abs_err > {x} THEN 1 ELSE 0 END), 8) AS tail_{x}s" for x in TAILS]) + " FROM eta")
def _(t):
    return rounded(metrics.within_thresholds(t.eta, inclusive=True), 8)


@query("v5_error_percentiles", "SELECT " + ", ".join([f"round(quantile_cont(abs_err, {p / 100}), 6) AS abs_p{p}" for p in (50, 75, 90, 95, 99)] + [f"round(quantile_cont(err, {p / 100}), 6) AS err_p{p}" for p in (5, 25, 50, 75, 95)]) + ", count(*) AS n FROM eta")
def _(t):
    return rounded(metrics.error_percentiles(t.eta))


@query("v6_moments", """
    WITH m AS (SELECT avg(err) AS m, stddev_pop(err) AS s FROM eta)
    SELECT round(any_value(m), 5) AS mean, round(any_value(s), 5) AS std, round(avg((err - m) ** 3) / any_value(s) ** 3, 6) AS skew, round(avg((err - m) ** 4) / any_value(s) ** 4 - 3, 6) AS kurtosis,
           round(min(err), 6) AS min_error, round(max(err), 6) AS max_error FROM eta, m""")
def _(t):
    return rounded(metrics.moments(t.eta), 6, mean=5, std=5)


@query("v7_compare_to_baseline", """
    WITH x AS (SELECT avg(abs(baseline - actual)) AS b, avg(abs_err) AS m, avg(CASE WHEN abs_err < abs(baseline - actual) THEN 1 ELSE 0 END) AS r FROM eta)
    SELECT round(b, 5) AS baseline_mae, round(m, 5) AS model_mae, round(r, 8) AS model_better_rate, round(b - m, 5) + 0.0 AS improvement_s, round((b - m) / b * 100, 6) + 0.0 AS improvement_pct FROM x""")
def _(t):
    return rounded(metrics.compare_to_baseline(t.eta), 5, model_better_rate=8, improvement_pct=6)


WL = """
    x AS (SELECT route_id, avg(abs(baseline - actual)) AS b, avg(abs_err) AS m, count(*) AS n FROM eta GROUP BY route_id),
    v AS (SELECT route_id, b, m, n, CASE WHEN m < b * 0.99 THEN 'WIN' WHEN m > b * 1.01 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM x)"""


@query("v8_win_loss", f"WITH {WL} SELECT route_id, round(b, 5) AS naive_mae, round(m, 5) AS model_mae, n, round((b - m) / b * 100, 6) + 0.0 AS improvement_pct, verdict, CASE WHEN n < 200 THEN 1 ELSE 0 END AS low_sample FROM v")
def _(t):
    return rounded(metrics.win_loss(t.eta, "route_id"), 5, improvement_pct=6)


@query("v8_win_loss_summary", f"WITH {WL} SELECT count(*) AS total, count_if(verdict = 'WIN')::BIGINT AS win, count_if(verdict = 'LOSS')::BIGINT AS loss, count_if(verdict = 'TIE')::BIGINT AS tie FROM v")
def _(t):
    return metrics.win_loss_summary(metrics.win_loss(t.eta, "route_id"))


@query("v9_bias_flags", f"""
    WITH x AS (SELECT *, {STOPS} AS stops FROM eta)
    SELECT stops, round(avg(err), 5) AS mean_err, round(avg(CASE WHEN err > 0 THEN 1 ELSE 0 END), 8) AS over_rate, count(*) AS n, round(median(err), 6) AS median_err,
           CASE WHEN avg(err) > 15 THEN 'OVER' WHEN avg(err) < -15 THEN 'UNDER' ELSE 'OK' END AS bias FROM x GROUP BY stops""")
def _(t):
    return rounded(metrics.bias_flags(sliced(t), "stops"), 5, over_rate=8, median_err=6)


@query("v9_bias_all_slices", f"""
    WITH x AS (SELECT err, {STOPS} AS stops, route_id, hour FROM eta),
         u AS (SELECT 'stops' AS dimension, stops::VARCHAR AS slice, err FROM x UNION ALL SELECT 'route_id', route_id::VARCHAR, err FROM x UNION ALL SELECT 'hour', hour::VARCHAR, err FROM x)
    SELECT dimension, slice, round(avg(err), 5) AS mean_err, round(avg(CASE WHEN err > 0 THEN 1 ELSE 0 END), 8) AS over_rate, count(*) AS n, round(median(err), 6) AS median_err,
           CASE WHEN avg(err) > 15 THEN 'OVER' WHEN avg(err) < -15 THEN 'UNDER' ELSE 'OK' END AS bias FROM u GROUP BY dimension, slice""")
def _(t):
    return rounded(metrics.bias_flags_all(sliced(t), ["stops", "route_id", "hour"]), 5, over_rate=8, median_err=6)


@query("v10_horizon_table", """
    SELECT CASE WHEN actual < 60 THEN '0-1min' WHEN actual < 120 THEN '1-2min' WHEN actual < 300 THEN '2-5min' WHEN actual < 600 THEN '5-10min' WHEN actual < 1200 THEN '10-20min' ELSE '20min+' END AS bucket,
           round(avg(abs_err), 5) AS mae, round(avg(err), 5) + 0.0 AS bias, count(*) AS n FROM eta GROUP BY 1 HAVING count(*) >= 50""")
def _(t):
    return rounded(metrics.horizon_table(t.eta, S.bucketize("actual", *S.TIME_BUCKETS), "bucket"), 5)


@query("v10_by_stops_away", "SELECT stops_away, round(avg(abs_err), 5) AS mae, round(avg(err), 5) + 0.0 AS bias, count(*) AS n FROM eta GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    return rounded(metrics.horizon_table(t.eta, F.col("stops_away"), "stops_away", 10), 5)


@query("v11_by_time_period", """
    SELECT hour, round(avg(abs_err), 5) AS mae, round(avg(err), 5) + 0.0 AS bias, count(*) AS n, CASE WHEN hour BETWEEN 7 AND 8 OR hour BETWEEN 16 AND 17 THEN 'rush' ELSE 'off_peak' END AS period
    FROM eta GROUP BY hour HAVING count(*) > 10""")
def _(t):
    return rounded(metrics.by_period(t.eta), 5)


@query("v11_period_totals", f"""
    WITH x AS (SELECT *, CASE WHEN hour BETWEEN 7 AND 8 THEN 'morning_rush' WHEN hour BETWEEN 16 AND 17 THEN 'afternoon_rush' ELSE 'off_peak' END AS period FROM eta)
    SELECT period, {M}, round(median(abs_err), 6) AS median_ae FROM x GROUP BY period""")
def _(t):
    return rounded(metrics.period_totals(t.eta), 5, median_ae=6)


@query("v12_by_feature_range", """
    SELECT CASE WHEN speed >= 0 AND speed < 5 THEN '0-5' WHEN speed >= 5 AND speed < 15 THEN '5-15' WHEN speed >= 15 AND speed < 25 THEN '15-25' WHEN speed >= 25 AND speed < 50 THEN '25-50' END AS range,
           round(avg(abs_err), 5) AS mae, round(avg(err), 5) + 0.0 AS bias, count(*) AS n, round(avg(abs(baseline - actual)), 5) AS baseline_mae,
           CASE WHEN avg(abs_err) < avg(abs(baseline - actual)) THEN 1 ELSE 0 END AS model_better FROM eta WHERE speed >= 0 AND speed < 50 GROUP BY 1""")
def _(t):
    return rounded(metrics.by_feature_range(t.eta, "speed", [(0, 5), (5, 15), (15, 25), (25, 50)], "baseline"), 5)


LEFT = "((coalesce(eta_minutes, 0) - ((ts_ms - 21600000) % 86400000) / 60000) * 60)"


@query("v13_system_eta_accuracy", f"""
    WITH m AS (SELECT p.*, (a.arrival_ms - p.ts_ms) / 1000 AS actual FROM pings p ASOF JOIN arrivals a ON p.vehicle_id = a.vehicle_id AND p.ts_ms < a.arrival_ms WHERE a.arrival_ms - p.ts_ms <= 172800000),
         e AS (SELECT actual, {LEFT} AS eta_s FROM m WHERE coalesce(eta_minutes, 0) > 0 AND {LEFT} > 0)
    SELECT count(*) AS n, round(avg(abs(eta_s - actual)), 4) AS mae, round(avg(eta_s - actual), 4) AS bias, round(avg(CASE WHEN abs(eta_s - actual) <= 3600 THEN 1 ELSE 0 END), 8) AS within_1h,
           round(corr(eta_s, actual), 6) AS correlation FROM e""")
def _(t):
    known = joins.asof_next(t.pings, t.arrivals, ["vehicle_id"], "ts_ms", "arrival_ms", 172_800_000, "next_ms", strict=True).where("next_ms IS NOT NULL")
    feed = quality.eta_seconds_with_flag(known, "eta_minutes", "ts_ms", "eta_s").where("has_eta_s = 1")
    scored = metrics.with_errors(feed.withColumn("actual", (F.col("next_ms") - F.col("ts_ms")) / F.lit(1000.0)), "actual", "eta_s")
    return rounded(scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_err").alias("mae"), F.avg("err").alias("bias"), F.avg((F.col("abs_err") <= 3600).cast("int")).alias("within_1h"),
        F.corr("eta_s", "actual").alias("correlation")), 4, within_1h=8, correlation=6)


@query("v14_worst_k", "SELECT order_id, part_id, supp_id, line, round(abs_err, 6) AS abs_err FROM eta ORDER BY eta.abs_err DESC, order_id, part_id, supp_id LIMIT 25")
def _(t):
    return rounded(metrics.worst_k(t.eta, 25, ["order_id", "part_id", "supp_id"]).select("order_id", "part_id", "supp_id", "line", "abs_err"))


@query("v15_quantile_eval", """
    WITH x AS (SELECT actual AS y, predicted - distance_m / 10 AS a, predicted AS b, predicted + schedule_eta * 5 - 100 AS c FROM eta WHERE schedule_eta IS NOT NULL),
         s AS (SELECT y, (a > b OR b > c OR a > c) AS cr, least(a, b, c) AS lo, greatest(a, b, c) AS hi FROM x)
    SELECT count(*) AS n, count_if(cr)::BIGINT AS n_crossing, round(avg(hi - lo), 5) AS mean_range, round(avg(CASE WHEN hi - lo < 60 THEN 1 ELSE 0 END), 8) AS narrow_rate, round(avg(CASE WHEN hi - lo > 300 THEN 1 ELSE 0 END), 8) AS wide_rate,
           round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END), 8) AS coverage, round(median(hi - lo), 6) AS median_range FROM s""")
def _(t):
    p = F.col("predicted")
    rows = t.eta.where("schedule_eta IS NOT NULL").select("actual", (p - F.col("distance_m") / 10).alias("a"), p.alias("b"), (p + F.col("schedule_eta") * 5 - 100).alias("c"))
    return rounded(metrics.quantile_eval(rows, "a", "b", "c", "actual"), 8, mean_range=5, median_range=6)


@query("v16_loss_metrics", """
    WITH x AS (SELECT actual AS y, predicted AS p, err AS e, greatest(err, 0) AS o, greatest(1, least(3, 1 + 2 * (1 - predicted / 300))) AS nr, ln(1 + greatest(predicted, 0)) - ln(1 + actual) AS le FROM eta)
    SELECT round(avg(CASE WHEN y - p >= 0 THEN 0.2 * (y - p) ELSE -0.8 * (y - p) END), 5) AS pinball_20, round(avg(CASE WHEN y - p >= 0 THEN 0.5 * (y - p) ELSE -0.5 * (y - p) END), 5) AS pinball_50,
           round(avg(CASE WHEN y - p >= 0 THEN 0.75 * (y - p) ELSE -0.25 * (y - p) END), 5) AS pinball_75, round(avg(e * e + 5 * o * o), 3) AS asymmetric_squared,
           round(avg((CASE WHEN abs(e) < 60 THEN 0.5 * e * e ELSE 60 * (abs(e) - 30) END) + 5 * (CASE WHEN o < 60 THEN 0.5 * o * o ELSE 60 * (o - 30) END)), 4) AS asymmetric_huber,
           round(avg((CASE WHEN e > 0 THEN 3 * nr ELSE 1 END) * e * e * 0.5), 3) AS proximity_weighted, round(avg(le * le + 5 * greatest(le, 0) * greatest(le, 0)), 7) AS log_space FROM x""")
def _(t):
    return rounded(metrics.loss_metrics(t.eta), 5, asymmetric_squared=3, asymmetric_huber=4, proximity_weighted=3, log_space=7)


@query("v16_ordering_penalty", "SELECT round(avg(greatest(actual - predicted, 0) + greatest(predicted - baseline, 0)), 6) AS ordering_penalty FROM eta")
def _(t):
    return rounded(metrics.ordering_penalty(t.eta.withColumn("etas", F.array("actual", "predicted", "baseline")), "etas"))


@query("v17_reconstruct_eta", "SELECT order_id, part_id, supp_id, line, round(baseline + pred_residual, 6) AS predicted, CASE WHEN schedule_eta IS NOT NULL THEN greatest(schedule_eta, 0) END AS naive FROM predictions")
def _(t):
    out = metrics.reconstruct_eta(t.predictions, schedule="schedule_eta").withColumn("naive", F.when(F.col("schedule_eta").isNotNull(), F.col("naive")))
    return rounded(out.select("order_id", "part_id", "supp_id", "line", "predicted", "naive"))


@query("v18_error_histogram", "SELECT floor((err + 2000) / 20)::BIGINT AS bin, count(*) AS n FROM eta WHERE err >= -2000 AND err < 2000 GROUP BY 1")
def _(t):
    return metrics.error_histogram(t.eta, "err", -2000, 2000, 20)


@query("v19_improvement_chain", """
    WITH r AS (SELECT 1 AS step, 'schedule' AS model, avg(abs(schedule_eta - actual)) AS mae FROM predictions UNION ALL SELECT 2, 'baseline', avg(abs(baseline - actual)) FROM predictions UNION ALL SELECT 3, 'model', avg(abs_err) FROM eta)
    SELECT step, model, round(mae, 5) AS mae, round((first_value(mae) OVER (ORDER BY step) - mae) / first_value(mae) OVER (ORDER BY step) * 100, 6) + 0.0 AS vs_naive_pct,
           round((lag(mae) OVER (ORDER BY step) - mae) / lag(mae) OVER (ORDER BY step) * 100, 6) + 0.0 AS vs_previous_pct FROM r""")
def _(t):
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    row = t.eta.agg(err("schedule_eta").alias("schedule"), err("baseline").alias("baseline"), F.avg("abs_err").alias("model"))
    steps = F.create_map(F.lit("schedule"), F.lit(1), F.lit("baseline"), F.lit(2), F.lit("model"), F.lit(3))
    tall = row.unpivot([], ["schedule", "baseline", "model"], "model", "mae").withColumn("step", steps[F.col("model")])
    return rounded(metrics.improvement_chain(tall), 6, mae=5)


FEATURES = ["actual", "baseline", "distance_m", "speed", "schedule_eta"]


@query("d1_feature_stats", " UNION ALL ".join(f"""
    SELECT '{f}' AS feature, count(*) AS n, count_if({f} IS NULL)::BIGINT AS n_null, round(avg({f}), 5) AS mean, round(stddev_pop({f}), 5) AS std, round(min({f}), 6) AS min, round(max({f}), 6) AS max, round(count_if({f} IS NULL) / count(*) * 100, 6) AS null_pct,
           {', '.join(f"round(quantile_cont({f}, {q}), 6) AS {n}" for n, q in (('p5', 0.05), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p95', 0.95)))} FROM predictions""" for f in FEATURES))
def _(t):
    return rounded(shift.feature_stats(t.predictions, FEATURES), 6, mean=5, std=5)


FLAG = "c AS (SELECT quantile_cont(abs_err, 0.9) AS a, quantile_cont(abs_err, 0.98) AS b FROM eta), f AS (SELECT eta.*, CASE WHEN abs_err >= a THEN 1 ELSE 0 END AS high_error, CASE WHEN abs_err >= b THEN 1 ELSE 0 END AS tail_error FROM eta, c)"


def flagged(t):
    return shift.high_error_split(t.eta)


@query("d2_high_error_split", f"""
    WITH {FLAG} SELECT round(avg(abs_err), 5) AS overall_mae, round(avg(abs_err) FILTER (high_error = 1), 5) AS high_error_mae, round(avg(abs_err) FILTER (tail_error = 1), 5) AS tail_error_mae,
           sum(high_error)::BIGINT AS n_high, sum(tail_error)::BIGINT AS n_tail, count(*) AS n FROM f""")
def _(t):
    return rounded(shift.high_error_summary(flagged(t)), 5)


def ks_sql(f):
    return f"""SELECT '{f}' AS feature, max(abs(ca / na - cb / nb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
        FROM (SELECT {f} AS v, count(*) AS a, sum(high_error) AS b FROM f WHERE {f} IS NOT NULL GROUP BY 1))"""


KS = f"WITH {FLAG}, ks AS (" + " UNION ALL ".join(ks_sql(f) for f in FEATURES) + ")"


@query("d3_ks_statistic", KS + " SELECT feature, round(ks, 8) AS ks FROM ks")
def _(t):
    return rounded(shift.ks_statistic(materialize(flagged(t)), FEATURES, "high_error"), 8)


# a category that some rows lack
D4 = """k AS (SELECT CASE WHEN order_id % 13 <> 0 THEN stops_away END AS c, count(*) AS o, sum(high_error) AS h FROM f GROUP BY 1),
         n AS (SELECT sum(o) FILTER (c IS NOT NULL) AS so, sum(h) FILTER (c IS NOT NULL) AS sh, sum(o) AS ro, sum(h) AS rh FROM k),
         p AS (SELECT o / so AS po, h / sh AS ph, (o / so + h / sh) * 0.5 AS m, h, o * (sh / so) AS ex, abs((rh - sh) / rh - (ro - so) / ro) * 100 AS gap FROM k, n WHERE c IS NOT NULL),
         j AS (SELECT 0.5 * sum(po * ln((po + 1e-10) / (m + 1e-10))) + 0.5 * sum(ph * ln((ph + 1e-10) / (m + 1e-10))) AS js, sum((h - ex) ** 2 / ex) AS chi2, count(*) AS n, any_value(gap) AS gap FROM p)"""


def with_category(t):
    return flagged(t).withColumn("stops", F.when(F.col("order_id") % 13 != 0, F.col("stops_away")))


@query("d4_category_shift", f"WITH {FLAG}, {D4} SELECT 'stops' AS feature, round(js, 9) AS js_divergence, round(chi2, 5) AS chi2, n AS n_categories, round(js * 5 + gap * 0.02, 9) AS shift_score FROM j")
def _(t):
    return rounded(shift.category_shift(with_category(t), "stops", "high_error"), 9, chi2=5)


SHIFT = KS + ", s AS (" + " UNION ALL ".join(f"""
    SELECT '{f}' AS feature, avg(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS nr, avg(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) FILTER (high_error = 1) AS nh, avg({f}) AS m, avg({f}) FILTER (high_error = 1) AS mh,
           stddev_pop({f}) AS sd, stddev_pop({f}) FILTER (high_error = 1) AS sh FROM f""" for f in FEATURES) + "), g AS (SELECT s.*, ks, CASE WHEN sd > 1e-10 THEN (mh - m) / sd ELSE 0 END AS gap FROM s JOIN ks USING (feature))"


@query("d5_shift_score", SHIFT + " SELECT feature, round(ks, 8) AS ks, round(gap, 7) + 0.0 AS mean_gap, round(ks * 0.5 + abs(gap) * 0.3 + abs(nh - nr) * 0.2, 7) AS shift_score FROM g")
def _(t):
    return rounded(shift.shift_table(materialize(flagged(t)), FEATURES, "high_error").select("feature", "ks", "mean_gap", "shift_score"), 7, ks=8)


@query("d5_shift_ranking", SHIFT + f""", {D4}, r AS (SELECT feature, 'numeric' AS kind, ks * 0.5 + abs(gap) * 0.3 + abs(nh - nr) * 0.2 AS v FROM g UNION ALL SELECT 'stops', 'category', js * 5 + gap * 0.02 FROM j)
    SELECT feature, kind, round(v, 7) AS shift_score, row_number() OVER (ORDER BY v DESC, feature)::INTEGER AS rank FROM r""")
def _(t):
    return rounded(shift.shift_ranking(materialize(with_category(t)), FEATURES, ["stops"], "high_error"), 7)


@query("d6_shift_flags", SHIFT + """ SELECT feature, array_to_string(list_sort(list_filter([CASE WHEN nr > 0.5 THEN 'HIGH_NAN_OVERALL' END, CASE WHEN (nh - nr) * 100 > 5 THEN 'NAN_RATE_SPIKE' END, CASE WHEN abs(gap) > 0.5 THEN 'MEAN_SHIFT' END,
        CASE WHEN ks > 0.15 THEN 'STRONG_KS' END, CASE WHEN sd = 0 OR sh = 0 THEN 'ZERO_VARIANCE' END], lambda x: x IS NOT NULL)), ',') AS flags FROM g""")
def _(t):
    return shift.shift_flags(shift.shift_table(materialize(flagged(t)), FEATURES, "high_error")).select("feature", "flags")


@query("d7_error_by_quantile_bin", """
    WITH q AS (SELECT list_sort(list_distinct(quantile_cont(actual, [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]))) AS e FROM eta)
    SELECT greatest(len(list_filter(e, lambda x: x < actual)), 1)::INTEGER AS bin, round(avg(abs_err), 5) AS mean_error, count(*) AS n, round(min(actual), 9) AS low, round(max(actual), 9) AS high FROM eta, q GROUP BY 1""")
def _(t):
    return rounded(shift.error_by_quantile_bin(t.eta, "actual"), 5, low=9, high=9)


@query("d7_error_by_category", "SELECT stops_away, round(avg(abs_err), 5) AS mean_error, count(*) AS n FROM eta GROUP BY 1")
def _(t):
    return rounded(shift.error_by_category(t.eta, "stops_away"), 5)


RANGES = {"train": (0, 19742), "val": (19744, 19748), "test": (19750, 999999)}
SPLIT = "s AS (SELECT event_id, ts_ms // 86400000 AS day, CASE WHEN ts_ms // 86400000 BETWEEN 0 AND 19742 THEN 'train' WHEN ts_ms // 86400000 BETWEEN 19744 AND 19748 THEN 'val' WHEN ts_ms // 86400000 BETWEEN 19750 AND 999999 THEN 'test' END AS split FROM pings)"


@query("p1_temporal_split", f"WITH {SPLIT} SELECT event_id, day, split FROM s WHERE split IS NOT NULL")
def _(t):
    return splits.temporal_split(t.pings.withColumn("day", epoch_day("ts_ms")), "day", RANGES).select("event_id", "day", "split")


@query("p2_split_checks", f"""
    WITH {SPLIT}, p AS (SELECT split, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM s WHERE split IS NOT NULL GROUP BY split)
    SELECT *, lead(first_day) OVER (ORDER BY first_day) - last_day - 1 AS gap_days, CASE WHEN coalesce(lead(first_day) OVER (ORDER BY first_day) - last_day - 1, 1) >= 1 THEN 1 ELSE 0 END AS ok FROM p""")
def _(t):
    return splits.split_checks(splits.temporal_split(t.pings.withColumn("day", epoch_day("ts_ms")), "day", RANGES), "day")


ORDER = ["ts_ms", "event_id"]


@query("p3_ratio_time_split", """
    WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts_ms, event_id) AS rank, count(*) OVER () AS n FROM pings)
    SELECT event_id, CASE WHEN rank <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split, rank FROM r""")
def _(t):
    return splits.ratio_time_split(t.pings, "ts_ms", ORDER).select("event_id", "split", "rank")


SHARE = "(('0x' || substr(md5('42|' || event_id), 1, 8))::BIGINT / 4294967296)"


@query("p4_random_split", f"SELECT event_id, CASE WHEN {SHARE} < 0.8 THEN 'train' WHEN {SHARE} < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM pings")
def _(t):
    return splits.random_split(t.pings, ["event_id"]).select("event_id", "split")


@query("p5_ts_cv_folds", """
    WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts_ms, event_id) AS rank, count(*) OVER () // 5 AS size, count(*) OVER () AS n FROM pings)
    SELECT event_id, CASE WHEN rank <= n - size * 4 THEN 0 ELSE (rank - (n - size * 4) - 1) // size + 1 END::INTEGER AS part FROM r""")
def _(t):
    return splits.ts_cv_folds(t.pings, "ts_ms", ORDER).select("event_id", "part")


@query("p6_subsample", f"SELECT event_id FROM pings WHERE {SHARE} < 0.25")
def _(t):
    return splits.subsample(t.pings, ["event_id"], 0.25).select("event_id")


@query("p7_dedupe_samples", "SELECT vehicle_id, passenger_load, kind, min(event_id) AS event_id FROM pings GROUP BY ALL")
def _(t):
    return splits.dedupe_samples(t.pings.select("vehicle_id", "passenger_load", "kind", "event_id"), ["vehicle_id", "passenger_load", "kind"], ["event_id"])


@query("p8_route_partition", "SELECT CASE WHEN route_id = 3 THEN 'demand_response' ELSE 'fixed_route' END AS dataset, count(*) AS n, round(avg(speed), 6) AS mean_speed, round(stddev_pop(speed), 6) AS std_speed FROM pings GROUP BY 1")
def _(t):
    parts = splits.route_partition(t.pings, 3)
    return rounded(parts.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean_speed"), F.stddev_pop("speed").alias("std_speed")))


@query("v13_approach_error", """
    WITH c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR lag(passenger_load // 30) OVER w <> passenger_load // 30 THEN 1 ELSE 0 END AS brk FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms, event_id)),
         r AS (SELECT *, sum(brk) OVER (PARTITION BY vehicle_id ORDER BY ts_ms, event_id) AS run FROM c),
         g AS (SELECT vehicle_id, min(ts_ms) AS run_start_ms, count(*) AS n_pings FROM r GROUP BY vehicle_id, run HAVING count(*) >= 3)
    SELECT g.vehicle_id, run_start_ms, n_pings, CASE WHEN a.arrival_ms - run_start_ms <= 172800000 THEN a.arrival_ms END AS arrival_at FROM g ASOF LEFT JOIN arrivals a ON a.vehicle_id = g.vehicle_id AND run_start_ms < a.arrival_ms""")
def _(t):
    runs = events.approach_sequences(t.pings.withColumn("side", F.floor(F.col("passenger_load") / 30)), "side")
    out = joins.asof_next(runs, t.arrivals, ["vehicle_id"], "run_start_ms", "arrival_ms", 172_800_000, "arrival_at", strict=True)
    return out.select("vehicle_id", "run_start_ms", "n_pings", "arrival_at")


SAID = "s AS (SELECT eta_minutes * 3 - (arrival_ms - run_start_ms) / 1000 AS err FROM (SELECT g.*, a.arrival_ms FROM g ASOF JOIN arrivals a ON a.vehicle_id = g.vehicle_id AND run_start_ms < a.arrival_ms) WHERE arrival_ms - run_start_ms <= 172800000 AND eta_minutes IS NOT NULL)"


@query("v13_approach_summary", f"""
    WITH c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR lag(passenger_load // 30) OVER w <> passenger_load // 30 THEN 1 ELSE 0 END AS brk FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms, event_id)),
         r AS (SELECT *, sum(brk) OVER (PARTITION BY vehicle_id ORDER BY ts_ms, event_id) AS run FROM c),
         g0 AS (SELECT vehicle_id, min(ts_ms) AS run_start_ms, count(*) AS n_pings FROM r GROUP BY vehicle_id, run HAVING count(*) >= 3),
         g AS (SELECT g0.*, eta_minutes FROM g0 JOIN pings p ON p.vehicle_id = g0.vehicle_id AND p.ts_ms = g0.run_start_ms), {SAID},
         e AS (SELECT err, abs(err) AS abs_err FROM s)
    SELECT count(*) AS n, round(median(abs_err), 4) AS median_ae, round(avg(CASE WHEN err > 0 THEN 1 ELSE 0 END), 8) AS overestimate_rate, round(coalesce(avg(abs_err) FILTER (err > 0), 0), 2) AS overestimate_mae,
           round(coalesce(avg(abs_err) FILTER (err < 0), 0), 2) AS underestimate_mae, {', '.join(f"round(avg(CASE WHEN abs_err < {x} THEN 1 ELSE 0 END), 8) AS within_{x}s" for x in LIMITS)} FROM e""")
def _(t):
    runs = events.approach_sequences(t.pings.withColumn("side", F.floor(F.col("passenger_load") / 30)), "side")
    matched = joins.asof_next(runs, t.arrivals, ["vehicle_id"], "run_start_ms", "arrival_ms", 172_800_000, "arrival_at", strict=True)
    said = t.pings.where("eta_minutes IS NOT NULL").select("vehicle_id", F.col("ts_ms").alias("run_start_ms"), (F.col("eta_minutes") * 3).alias("said_s"))
    rows = matched.where("arrival_at IS NOT NULL").join(said, ["vehicle_id", "run_start_ms"]).withColumn("actual_s", (F.col("arrival_at") - F.col("run_start_ms")) / F.lit(1000.0))
    out = quality.approach_summary(materialize(metrics.with_errors(rows, "actual_s", "said_s")), LIMITS)
    return rounded(out, 8, median_ae=4, overestimate_mae=2, underestimate_mae=2)


@query("f19_label_histogram", "SELECT CASE WHEN actual < 60 THEN '0-60s' WHEN actual < 300 THEN '60-300s' WHEN actual < 600 THEN '300-600s' WHEN actual < 1800 THEN '600-1800s' ELSE '1800s+' END AS bucket, count(*) AS n, round(avg(actual), 5) AS mean_s FROM predictions GROUP BY 1")
def _(t):
    return t.predictions.groupBy(S.bucketize("actual", *S.LABEL_BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), near(F.avg("actual"), 5).alias("mean_s"))
