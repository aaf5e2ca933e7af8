"""Boosted residual model on Spark (ML*) and the batch chain."""

from pyspark.sql import functions as F

from pingloom.catalog.registry import query, rounded
from pingloom.catalog.tiers import cascade
from pingloom.operators import metrics, model, splits
from pingloom.plans.relabel import CTES
from pingloom.plans.stages import materialize
from pingloom.streaming import live

INPUTS = ["distance_m", "speed", "stops_away", "hour", "schedule_eta"]


def rows(t):
    return t.predictions.select("order_id", "part_id", "supp_id", "line", "route_id", "actual", "baseline", *INPUTS, (F.col("actual") - F.col("baseline")).alias("residual"))


def fitted(t):
    # written once: the fit reads its rows five times, and a row's share is a digest
    parts = materialize(splits.random_split(rows(t), ["order_id", "part_id", "supp_id", "line"]))
    train = parts.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    return model.fit_gbt(train, INPUTS, "residual", "is_val", trees=8, depth=4), parts.where("split = 'test'")


@query("ml1_ml2_fit_and_score")
def _(t):
    gbt, held = fitted(t)
    scored = model.score(held, gbt, INPUTS)
    out = metrics.with_errors(scored, "actual", "predicted")
    return rounded(out.groupBy("route_id").agg(F.avg("abs_err").alias("mae"), F.avg(F.abs(F.col("baseline") - F.col("actual"))).alias("baseline_mae"), F.count(F.lit(1)).alias("n")), 4)


@query("ml3_temporal_cv")
def _(t):
    parts = splits.ts_cv_folds(rows(t).withColumn("pos", F.col("order_id") * 3_600_000), "pos", ["pos", "part_id", "supp_id", "line", "actual"])
    return rounded(model.temporal_cv(parts, INPUTS, "residual", trees=3, depth=3), 4)


def folds_of(t):
    parts = splits.ts_cv_folds(rows(t).withColumn("pos", F.col("order_id") * 3_600_000), "pos", ["pos", "part_id", "supp_id", "line", "actual"])
    return materialize(model.temporal_cv(parts, INPUTS, "residual", trees=3, depth=3))


# a boosted tree has no SQL, but what must hold of its scores has: sizes of folds, finite errors, mean and deviation within bounds
@query("ml3_cv_checks", """
    WITH n AS (SELECT count(*) AS total, count(*) // 5 AS size FROM predictions)
    SELECT 4::BIGINT AS n_folds, size * 4 AS n, true AS all_folds_equal, true AS mean_between, true AS deviation_fits, true AS better_than_nothing FROM n""")
def _(t):
    folds = folds_of(t)
    spread = folds.agg((F.min("n") == F.max("n")).alias("e")).scalar()
    naive = rows(t).agg(F.max(F.abs("residual")).alias("m")).scalar()
    s = model.cv_summary(folds)
    return s.select(F.col("n_folds").cast("long").alias("n_folds"), F.col("n").cast("long").alias("n"), spread.alias("all_folds_equal"), F.col("mean_mae").between(F.col("best_mae"), F.col("worst_mae")).alias("mean_between"),
                    (F.col("std_mae") <= (F.col("worst_mae") - F.col("best_mae")) / 2 + 1e-9).alias("deviation_fits"), (F.col("worst_mae") < naive).alias("better_than_nothing"))


@query("ml1_fit_checks", "SELECT (SELECT count(DISTINCT route_id) FROM predictions) AS n_routes, true AS all_finite, true AS better_than_baseline")
def _(t):
    """Rows scored after a fit: every route, no missing prediction, a lower error than the baseline's."""
    gbt, held = fitted(t)
    out = metrics.with_errors(model.score(held, gbt, INPUTS), "actual", "predicted")
    return out.agg(F.count_distinct("route_id").alias("n_routes"), F.bool_and(F.col("predicted").isNotNull() & ~F.isnan("predicted")).alias("all_finite"),
                   (F.avg("abs_err") < F.avg(F.abs(F.col("baseline") - F.col("actual")))).alias("better_than_baseline"))


@query("ml4_importance_checks", f"SELECT {len(INPUTS)}::BIGINT AS n_inputs, 1.0::DOUBLE AS total, true AS none_negative")
def _(t):
    gbt, _ = fitted(t)
    return model.feature_importance(t.spark, gbt, INPUTS).agg(F.count("*").alias("n_inputs"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative"))


LATEST = "latest AS (SELECT vehicle_id, arg_max(route_id, ts_ms * 1000000 + event_id) AS route_id, arg_max(progress, ts_ms * 1000000 + event_id) AS progress, arg_max(speed, ts_ms * 1000000 + event_id) AS speed, max(ts_ms) AS ts_ms FROM pings GROUP BY vehicle_id)"


@query("ml2_vehicle_stop_scores", f"""
    WITH {LATEST} SELECT vehicle_id, l.route_id, stop_id, round(abs(stop_progress - progress) * max_dist * 1609.344, 4) AS distance_m, round(abs(stop_progress - progress) * max_dist * 120, 4) AS baseline, true AS adds_up
    FROM latest l JOIN stop_seq USING (route_id)""")
def _(t):
    """Each vehicle's latest position x all stops of its route; the model's part of the score is checked to add up."""
    gbt, _ = fitted(t)
    latest = live.latest_positions(t.pings.select("vehicle_id", "route_id", "event_id", "ts_ms", "progress", "speed"))
    way = F.abs(F.col("stop_progress") - F.col("progress")) * F.col("stop_max_dist")
    inputs = {"distance_m": way * 1609.344, "speed": F.col("speed"), "stops_away": F.col("stop_sequence"), "hour": F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)), "schedule_eta": way * 120}
    out = model.score_vehicle_stops(latest, t.stop_seq, gbt, INPUTS, inputs, way * 120)
    adds = (F.abs(F.col("predicted") - F.col("baseline") - F.col("pred_residual")) < 1e-6) & ~F.isnan("predicted")
    return rounded(out.select("vehicle_id", "route_id", "stop_id", "distance_m", "baseline", adds.alias("adds_up")), 4)


@query("ml4_feature_importance")
def _(t):
    gbt, _ = fitted(t)
    return rounded(model.feature_importance(t.spark, gbt, INPUTS), 6)


def chain_sql():
    """The whole chain in SQL: the same steps over cleaned, thinned pings."""
    own = lambda text: text.replace("labeled", "clabeled").replace("BETWEEN 19744 AND 999999", "BETWEEN 19750 AND 999999")
    last = lambda c: f"arg_max({c}, ts_ms * 1000000 + event_id) FILTER ({c} IS NOT NULL) AS {c}"
    columns = ["event_id", "vehicle_name", "ts_ms", "speed", "progress", "lat", "lon", "heading", "passenger_load", "pattern_id", "status", "last_stop_id", "next_stop_id",
               "last_stop_time_ms", "last_stop_on_time", "eta_minutes", "kind"]
    thinned = f"""
        cpings AS (SELECT vehicle_id, route_id, {', '.join(last(c) for c in columns)} FROM pings
                   WHERE lat BETWEEN 32.5 AND 32.7 AND lon BETWEEN -85.6 AND -85.4 AND speed <= 65 AND NOT regexp_matches(vehicle_name, 'jaunt|shuttle', 'i') AND pattern_id <> 9998 AND progress <> -1
                     AND NOT (progress = 0 AND speed = 0) AND next_stop_id <> 0 AND route_id <> 237 GROUP BY vehicle_id, route_id, ts_ms // 60000)"""
    ahead = "cahead AS (" + CTES["ahead"].replace("FROM pings p", "FROM cpings p") + ")"
    matched = "cmatched AS (" + CTES["labeled"].replace("FROM ahead a", "FROM cahead a").replace("r.arrival_ms > a.ts_ms", "r.arrival_ms - a.ts_ms > 10000") + ")"
    trimmed = "clabeled AS (SELECT m.* FROM cmatched m JOIN (SELECT route_id, quantile_cont(label_s, 0.995) AS lim FROM cmatched GROUP BY route_id) q USING (route_id) WHERE label_s <= lim)"
    return f"""WITH {thinned}, {ahead}, {matched}, {trimmed}, {own(cascade())},
        e AS (SELECT route_id, label_s AS y, abs(estimate - label_s) AS a FROM sc WHERE day BETWEEN 19750 AND 999999 AND estimate IS NOT NULL)
        SELECT route_id, round(avg(a), 5) AS mae, round(sqrt(avg(a * a)), 5) AS rmse, round(avg(a / y) * 100, 5) AS mape, round(stddev_pop(a), 5) AS std_ae, count(*) AS n, round(median(a), 6) AS median_ae FROM e GROUP BY route_id"""


@query("batch_chain", chain_sql())
def _(t):
    from dataclasses import replace

    from pingloom.config import DEFAULTS
    from pingloom.plans.batch import BatchInputs, run_batch

    cfg = replace(DEFAULTS, asof_tolerance_ms=1_728_000_000, label_max_s=1_728_000.0)
    return rounded(run_batch(BatchInputs(t.pings, t.arrivals, t.stop_seq), {"train": (0, 19742), "val": (19744, 19748), "test": (19750, 999999)}, cfg, k=4), 5, median_ae=6)


# the baseline's side of the comparison has SQL; what must hold of the model's side is checked in the query
@query("batch_model", chain_sql().rsplit("SELECT route_id, round(avg(a), 5)", 1)[0] + "SELECT route_id, count(*) AS n, round(avg(a), 5) AS baseline_mae, true AS consistent FROM e GROUP BY route_id")
def _(t):
    from dataclasses import replace

    from pingloom.config import DEFAULTS
    from pingloom.plans.batch import BatchInputs, run_batch_model

    cfg = replace(DEFAULTS, asof_tolerance_ms=1_728_000_000, label_max_s=1_728_000.0)
    out = run_batch_model(BatchInputs(t.pings, t.arrivals, t.stop_seq), {"train": (0, 19742), "val": (19744, 19748), "test": (19750, 999999)}, cfg, k=4, trees=5, depth=4)
    gain = F.abs(F.col("improvement_pct") / 100 * F.col("baseline_mae") - (F.col("baseline_mae") - F.col("model_mae"))) < 1e-3
    fine = F.coalesce(gain & F.col("wins").between(0, 1) & ~F.isnan("model_mae"), F.lit(False))
    return rounded(out.select("route_id", "n", "baseline_mae", fine.alias("consistent")), 5)
