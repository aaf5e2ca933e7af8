"""The tier cascade and everything compared with it (A10-A12, A14-A16, ML5)."""

from pyspark.sql import functions as F

from pingloom.catalog.history import S2S, s2s
from pingloom.catalog.registry import query, rounded
from pingloom.catalog.scalars import SEGMENT
from pingloom.operators import metrics, tiers
from pingloom.plans.batch import baseline_stage
from pingloom.plans.relabel import TEST_DAYS, TRAIN_DAYS
from pingloom.plans.stages import materialize

TRAIN, TEST = "day BETWEEN 0 AND 19742", "day BETWEEN 19744 AND 999999"
BINS = f"""
    q AS (SELECT list_sort(list_distinct(quantile_cont((ts_ms - last_stop_time_ms) / 1000, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM labeled
          WHERE {TRAIN} AND ts_ms - last_stop_time_ms >= 0),
    ed AS (SELECT list_concat([0.0::DOUBLE], e[2:-2], ['Infinity'::DOUBLE]) AS e FROM q),
    b AS (SELECT s2s.*, CASE WHEN last_stop_time_ms IS NULL OR ts_ms < last_stop_time_ms THEN -1
                 ELSE greatest(least(len(list_filter(ed.e, lambda x: x < (ts_ms - last_stop_time_ms) / 1000)), len(ed.e) - 1), 1) - 1 END AS ela,
                 {SEGMENT} AS seg, CASE WHEN speed = 0 THEN 1 ELSE 0 END AS stp,
                 CASE WHEN last_stop_on_time IS NULL THEN -1 WHEN last_stop_on_time < 0 THEN 0 WHEN last_stop_on_time <= 1 THEN 1 WHEN last_stop_on_time <= 5 THEN 2 ELSE 3 END AS ot FROM s2s, ed)"""
TIERS = (("a", "ela, seg, stp, ot", True), ("b", "ela, seg, stp", True), ("c", "ela, seg", True), ("d", "ela", True), ("e", "seg", False), ("f", "", False))


def cascade(agg="median(label_s)", min_obs=2):
    keys = lambda extra: "route_id, last_stop_id, target_stop_id" + (", " + extra if extra else "")
    parts = [
        f"k{n} AS (SELECT {keys(x)}, {agg} AS v{n} FROM b WHERE {TRAIN}{' AND ela >= 0' if el else ''} GROUP BY {keys(x)} HAVING count(*) >= {min_obs})" for n, x, el in TIERS]
    joins = " ".join(f"LEFT JOIN k{n} USING ({keys(x)})" for n, x, _ in TIERS)
    vals = ", ".join(f"v{n}" for n, _, _ in TIERS)
    name = " ".join(f"WHEN v{n} IS NOT NULL THEN '{n.upper()}'" for n, _, _ in TIERS)
    return f"""{S2S}, {BINS}, {', '.join(parts)},
    sc AS (SELECT b.*, coalesce({vals}, baseline_s2s) AS estimate, CASE {name} WHEN baseline_s2s IS NOT NULL THEN 'last' ELSE 'none' END AS tier FROM b {joins})"""


def binned(t):
    """Rows with the stop-to-stop baseline and the binned dimensions, written once."""
    edges = tiers.quantile_bins_fit(t.train, tiers.elapsed_seconds())
    return materialize(tiers.with_tier_bins(s2s(t), edges))


def fitted(t):
    return baseline_stage(t.train, t.labeled, t.stop_seq, output="estimate")


def test_rows(t):
    return fitted(t).where(F.col("day").between(*TEST_DAYS))


@query("a10_tier_cascade", f"WITH {cascade()} SELECT event_id, target_stop_id, round(estimate, 7) AS estimate, tier FROM sc WHERE {TEST}")
def _(t):
    return rounded(test_rows(t).select("event_id", "target_stop_id", "estimate", "tier"), 7)


_CELL_COLUMNS = ("ela", "seg", "stp", "ot")
_CELLS = " UNION ALL ".join(
    f"SELECT {i} AS tier, route_id, last_stop_id, target_stop_id, " + ", ".join((c if c in x.split(", ") else "NULL::INTEGER") + f" AS {c}" for c in _CELL_COLUMNS)
    + f", round(median(label_s), 7) AS value, count(*) AS n FROM b WHERE {TRAIN}{' AND ela >= 0' if el else ''} GROUP BY ALL HAVING count(*) >= 2" for i, (_, x, el) in enumerate(TIERS))


@query("a10_cells_from_days", f"WITH {S2S}, {BINS} {_CELLS}")
def _(t):
    rows = tiers.with_tier_bins(t.train, tiers.quantile_bins_fit(t.train, tiers.elapsed_seconds()))
    days = materialize(tiers.tier_days(rows, tiers.BASELINE, "day"), partition_by=["day"])
    names = {tiers.E: "ela", tiers.S: "seg", tiers.P: "stp", tiers.O4: "ot", "_tier": "tier"}
    return rounded(tiers.tier_fit_days(days, tiers.BASELINE).withColumnsRenamed(names), 7)


@query("a11_tier_coverage", f"WITH {cascade()} SELECT tier, count(*) AS n, round(count(*) / (SELECT count(*) FROM sc) * 100, 6) AS pct FROM sc GROUP BY tier")
def _(t):
    return rounded(tiers.tier_coverage(materialize(fitted(t).select("tier"))))


@query("a12_residual", f"WITH {cascade()} SELECT event_id, target_stop_id, round(label_s - estimate, 7) + 0.0 AS residual FROM sc")
def _(t):
    return rounded(tiers.residual(fitted(t), "label_s", "estimate").select("event_id", "target_stop_id", "residual"), 7)


@query("a14_per_route_best", f"""
    WITH {cascade()}, e AS (SELECT route_id, avg(abs(label_s - estimate)) AS e0, avg(abs(label_s - baseline_s2s)) AS e1 FROM sc WHERE {TRAIN} GROUP BY route_id)
    SELECT event_id, target_stop_id, round(CASE WHEN e1 < e0 OR (e0 IS NULL AND e1 IS NOT NULL) THEN baseline_s2s ELSE estimate END, 7) AS best_value,
           CASE WHEN e1 < e0 OR (e0 IS NULL AND e1 IS NOT NULL) THEN 'baseline_s2s' ELSE 'estimate' END AS best_method FROM sc LEFT JOIN e USING (route_id) WHERE {TEST}""")
def _(t):
    rows = materialize(fitted(t))
    best = tiers.per_route_best(rows.where(F.col("day").between(*TRAIN_DAYS)), rows.where(F.col("day").between(*TEST_DAYS)), ["estimate", "baseline_s2s"])
    return rounded(best.select("event_id", "target_stop_id", "best_value", "best_method"), 7)


SWEEP_COLUMNS = {tiers.E: "ela", tiers.E15: "ela15", tiers.E20: "ela20", tiers.CUSTOM: "elac", tiers.S: "seg", tiers.P: "stp", tiers.O4: "ot", tiers.O3: "ot3", tiers.DAY: "day_type"}
OT3 = "CASE WHEN last_stop_on_time IS NULL THEN -1 WHEN last_stop_on_time < 0 THEN 0 WHEN last_stop_on_time <= 4 THEN 1 ELSE 2 END"
SPLIT = f"CASE WHEN {TRAIN} THEN 'train' WHEN day BETWEEN 19744 AND 19747 THEN 'val' WHEN day >= 19748 THEN 'test' END"


def elapsed_sql(edges: str) -> str:
    return f"CASE WHEN last_stop_time_ms IS NULL OR ts_ms < last_stop_time_ms THEN -1 ELSE greatest(least(len(list_filter({edges}, lambda x: x < (ts_ms - last_stop_time_ms) / 1000)), len({edges}) - 1), 1) - 1 END"


def more_edges(n: int) -> str:
    probs = ", ".join(repr(i / n) for i in range(n + 1))
    return f"""q{n} AS (SELECT list_sort(list_distinct(quantile_cont((ts_ms - last_stop_time_ms) / 1000, [{probs}]))) AS e FROM labeled WHERE {TRAIN} AND ts_ms - last_stop_time_ms >= 0),
    ed{n} AS (SELECT list_concat([0.0::DOUBLE], e[2:-2], ['Infinity'::DOUBLE]) AS e{n} FROM q{n})"""


def sweep_sql() -> str:
    """The scored rows of every configuration, each with its own lookup tables."""
    custom = "[0.0::DOUBLE, 10, 20, 30, 45, 60, 80, 100, 120, 160, 220, 300, 400, 'Infinity'::DOUBLE]"
    ctes = [more_edges(15), more_edges(20), f"bb AS (SELECT b.*, {OT3} AS ot3, {elapsed_sql('e15')} AS ela15, {elapsed_sql('e20')} AS ela20, {elapsed_sql(custom)} AS elac, {SPLIT} AS split FROM b, ed15, ed20)"]
    rows = []
    for i, config in enumerate(tiers.SWEEP):
        joins, values = [], []
        for j, tier in enumerate(config.tiers):
            keys = ", ".join(SWEEP_COLUMNS.get(k, k) for k in tier.keys)
            fn = "avg" if config.agg == "mean" else "median"
            valid = f" AND {SWEEP_COLUMNS[tier.elapsed]} >= 0" if tier.needs_elapsed else ""
            ctes.append(f"k{i}_{j} AS (SELECT {keys}, {fn}(label_s) AS v{j} FROM bb WHERE split = 'train'{valid} GROUP BY {keys} HAVING count(*) >= {config.min_obs})")
            joins.append(f"LEFT JOIN k{i}_{j} USING ({keys})")
            values.append(f"v{j}")
        names = " ".join(f"WHEN v{j} IS NOT NULL THEN '{t.name}'" for j, t in enumerate(config.tiers))
        tier = "NULL" if config.correction else f"CASE {names} WHEN baseline_s2s IS NOT NULL THEN 'last' END"
        ctes.append(f"p{i} AS (SELECT route_id, split, label_s, baseline_s2s, last_stop_on_time, stops_away, coalesce({', '.join(values)}, baseline_s2s) AS e, {tier} AS tier FROM bb {' '.join(joins)} WHERE split IS NOT NULL)")
        estimate, join = "e", ""
        if config.correction == "linear":
            estimate = "e + last_stop_on_time"
        if config.correction == "per_route":
            ctes.append(f"r{i} AS (SELECT route_id, avg(abs(label_s - baseline_s2s)) < coalesce(avg(abs(label_s - e)), 'Infinity'::DOUBLE) AS better FROM p{i} WHERE split = 'train' GROUP BY route_id)")
            estimate, join = "CASE WHEN better THEN baseline_s2s ELSE e END", f" LEFT JOIN r{i} USING (route_id)"
        rows.append(f"SELECT '{config.name}' AS config, split, label_s, {estimate} AS e, tier, stops_away FROM p{i}{join} WHERE split <> 'train'")
    return f"WITH {S2S}, {BINS}, {', '.join(ctes)}, scores AS ({' UNION ALL '.join(rows)})"


def scored(t):
    """All configurations' estimates; every day belongs to a split or to the gap between training and the others."""
    edges = tiers.quantile_bins_fit_all(t.train, tiers.elapsed_seconds(), [10, 15, 20])
    split = F.when(F.col("day").between(*TRAIN_DAYS), "train").when(F.col("day").between(19744, 19747), "val").when(F.col("day") >= 19748, "test")
    rows = materialize(tiers.with_sweep_bins(s2s(t), edges).withColumn("split", split).where("split IS NOT NULL"))
    return tiers.sweep_scores(rows, tiers.SWEEP, "label_s", "baseline_s2s")


@query("a15_config_sweep", sweep_sql() + """,
    t AS (SELECT config, avg(abs(label_s - e)) FILTER (split = 'test') AS mae, avg(abs(label_s - e)) FILTER (split = 'val') AS val_mae, count(e) FILTER (split = 'test') AS n_answered,
                 count(e) FILTER (split = 'test') / count(*) FILTER (split = 'test') * 100 AS pct FROM scores GROUP BY config)
    SELECT config, round(mae, 6) AS mae, round(val_mae, 6) AS val_mae, n_answered, round(pct, 6) AS coverage_pct, row_number() OVER (ORDER BY mae NULLS LAST, config) = 1 AS best FROM t""")
def _(t):
    return rounded(tiers.config_sweep(scored(t)))


_SWEEP_ITEMS = " UNION ALL ".join(
    f"SELECT config, split, '{name}' AS dimension, {item} AS item, avg(abs(label_s - e)) AS mae, count(e) AS n_answered, count(*) AS n FROM scores WHERE {item} IS NOT NULL GROUP BY ALL HAVING {having}"
    for name, item, having in (
        ("overall", "'all'", "true"),
        ("bucket", "CASE WHEN label_s < 0 THEN NULL WHEN label_s < 60 THEN '0-1min' WHEN label_s < 120 THEN '1-2min' WHEN label_s < 300 THEN '2-5min' WHEN label_s < 600 THEN '5-10min' WHEN label_s < 1200 THEN '10-20min' WHEN label_s < 1e9 THEN '20min+' END", "count(e) >= 1"),
        ("stops_away", "stops_away::VARCHAR", "count(e) >= 10"),
        ("tier", "tier", "count(e) >= 1")))


@query("a15_sweep_breakdown", sweep_sql() + f" SELECT config, split, dimension, item, round(mae, 6) AS mae, n_answered, n FROM ({_SWEEP_ITEMS})")
def _(t):
    return rounded(tiers.sweep_breakdown(scored(t)))


@query("a16_linear_correction", f"WITH {cascade()} SELECT event_id, target_stop_id, round(estimate + last_stop_on_time, 7) AS corrected FROM sc WHERE {TEST}")
def _(t):
    return rounded(tiers.linear_correction(test_rows(t), "estimate").select("event_id", "target_stop_id", "corrected"), 7)


@query("a10_baseline_error", f"""
    WITH {cascade()} SELECT route_id, round(avg(abs(estimate - label_s)), 6) AS mae, round(median(abs(estimate - label_s)), 7) AS median_ae, count(*) AS n FROM sc WHERE {TEST} AND estimate IS NOT NULL GROUP BY route_id""")
def _(t):
    scored = metrics.with_errors(materialize(test_rows(t)).where("estimate IS NOT NULL"), "label_s", "estimate")
    return rounded(metrics.regression_metrics(scored, ["route_id"], "label_s").select("route_id", "mae", "median_ae", "n"), 6, median_ae=7)


QUANT = "quantile_cont(label_s, 0.2)"


@query("ml5_tier_quantiles", f"""
    WITH {S2S}, k1 AS (SELECT route_id, last_stop_id, target_stop_id, quantile_cont(label_s, 0.2) AS a, quantile_cont(label_s, 0.5) AS b, quantile_cont(label_s, 0.75) AS c FROM labeled WHERE {TRAIN} GROUP BY ALL HAVING count(*) >= 3),
         k2 AS (SELECT route_id, target_stop_id, quantile_cont(label_s, 0.2) AS a, quantile_cont(label_s, 0.5) AS b, quantile_cont(label_s, 0.75) AS c FROM labeled WHERE {TRAIN} GROUP BY ALL HAVING count(*) >= 3)
    SELECT event_id, l.target_stop_id, round(coalesce(k1.a, k2.a), 7) AS p20, round(coalesce(k1.b, k2.b), 7) AS p50, round(coalesce(k1.c, k2.c), 7) AS p75, CASE WHEN k1.a IS NOT NULL THEN 'A' WHEN k2.a IS NOT NULL THEN 'B' ELSE 'none' END AS tier
    FROM labeled l LEFT JOIN k1 USING (route_id, last_stop_id, target_stop_id) LEFT JOIN k2 ON k2.route_id = l.route_id AND k2.target_stop_id = l.target_stop_id WHERE {TEST}""")
def _(t):
    config = tiers.TierConfig("quantiles", (tiers.Tier("A", tiers.STOPS), tiers.Tier("B", ("route_id", "target_stop_id"))), 3)
    rows = t.labeled.withColumn(tiers.E, F.lit(0))
    cells = tiers.tier_quantiles_fit(rows.where(F.col("day").between(*TRAIN_DAYS)), config, {"p20": 0.2, "p50": 0.5, "p75": 0.75})
    out = tiers.tier_apply(rows.where(F.col("day").between(*TEST_DAYS)), cells, config, values=("p20", "p50", "p75"))
    return rounded(out.select("event_id", "target_stop_id", "p20", "p50", "p75", "tier"), 7)
