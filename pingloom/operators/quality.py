"""Data-quality reports: single-pass aggregates over the table they describe."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS, HOUR_MS
from pingloom.functions.scalars import minutes_of_day_to_eta
from pingloom.functions.times import floor_div
from pingloom.operators.joins import asof_next, match_event_window
from pingloom.operators.quantiles import grouped_quantiles
from pingloom.plans.slices import lag_across


def null_rates(df: DataFrame) -> DataFrame:
    """Missing count and rate per column, and the rate of complete rows as the column ``*``."""
    n = F.count(F.lit(1))
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    row = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count_if(~complete).alias("*"))
    tall = row.unpivot(["_n"], [f"`{c}`" if c == "*" else c for c in [*df.columns, "*"]], "column", "n_null")
    return tall.select("column", "n_null", (F.try_divide("n_null", "_n") * 100).alias("null_pct"))


# fixed values: plausible ranges
RANGES = {
    "speed": (0.0, 80.0), "lat": (32.5, 32.7), "lon": (-85.6, -85.4), "progress": (-1.0, 1.0), "temperature_c": (-10.0, 45.0),
}


def range_checks(df: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Rows outside each range; columns the table lacks are skipped."""
    rules = {c: (F.col(c) < low) | (F.col(c) > high) for c, (low, high) in ranges.items() if c in df.columns}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(c) for c, r in rules.items()])
    tall = row.unpivot(["n"], list(rules), "column", "n_outside")
    return tall.withColumn("outside_pct", F.try_divide("n_outside", "n") * 100)


def rolling_consistency(df: DataFrame, short: str, long: str, average: str, speed: str, distance: str, turn: str) -> DataFrame:
    """Whether short windows vary more, and that sums and averages stay plausible."""
    return df.agg(
        F.avg(short).alias("short_std_mean"), F.avg(long).alias("long_std_mean"),
        F.avg(F.abs(F.col(average) - F.col(speed))).alias("avg_vs_instant"),
        F.count_if(F.col(distance) < 0).alias("n_negative_distance"), F.max(turn).alias("max_heading_change"),
    ).withColumn("shorter_more_variable", (F.col("short_std_mean") >= F.col("long_std_mean")).cast("int"))


def label_quality(df: DataFrame, label: str) -> DataFrame:
    x = F.col(label)
    stats = df.agg(
        F.count(x).alias("n_labels"), F.count_if(x.isNull()).alias("n_missing"), (F.avg(x.isNull().cast("int")) * 100).alias("missing_pct"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.count_if(x < 0).alias("n_negative"), F.count_if(x > 3600).alias("n_over_1h"), F.count_if(x > 1800).alias("n_over_30min"),
        F.count_if((x >= 0) & (x < 60)).alias("n_0_60"), F.count_if((x >= 60) & (x < 300)).alias("n_60_300"),
        F.count_if((x >= 300) & (x < 600)).alias("n_300_600"), F.count_if((x >= 600) & (x < 1800)).alias("n_600_1800"),
        F.count_if((x >= 1800) & (x <= 3600)).alias("n_1800_3600"),
    )
    median = grouped_quantiles(df, [], label, {"m": 0.5}).select("m").scalar()
    return stats.withColumn("median", median)


def join_quality(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Match rate overall and per value of each column, in one GROUPING SETS pass."""
    cols = [F.col(c) for c in by]
    grouped = df.groupingSets([[], *[[c] for c in cols]], *cols).agg(
        F.grouping_id(*cols).alias("_g"), F.count(F.lit(1)).alias("n"), F.count(label).alias("n_labeled"))
    full = (1 << len(by)) - 1
    dim, value = F.when(F.col("_g") == full, F.lit("overall")), F.when(F.col("_g") == full, F.lit("all"))
    for i, c in enumerate(by):
        mine = F.col("_g") == full - (1 << (len(by) - 1 - i))
        dim, value = dim.when(mine, F.lit(c)), value.when(mine, F.col(c).cast("string"))
    return grouped.select(
        dim.alias("dimension"), value.alias("value"), "n", "n_labeled", (F.col("n_labeled") / F.col("n") * 100).alias("match_pct"),
        (F.col("n_labeled") < 100).cast("int").alias("few_samples"))


def weather_coverage(weather: DataFrame, hour: str, first_ms: Column, last_ms: Column) -> DataFrame:
    """Hours of the range without weather. ``first_ms``/``last_ms`` may be scalar subqueries."""
    span = weather.groupBy().agg(F.count(F.lit(1)).alias("_any"))
    hours = span.select(F.explode(F.sequence(floor_div(first_ms, HOUR_MS), floor_div(last_ms, HOUR_MS))).alias("_h"))
    known = weather.select(floor_div(hour, HOUR_MS).alias("_h")).distinct()
    return hours.join(known, "_h", "left_anti").select((F.col("_h") * HOUR_MS).alias("missing_hour_ms"))


def spike_check(df: DataFrame, label: str, low: float = 3540, high: float = 3660, limit_pct: float = 5.0) -> DataFrame:
    """Share of labels round one hour (a time-zone slip) and just under the hour (a cut-off)."""
    x = F.col(label)
    return df.agg(
        F.count(x).alias("n"), F.count_if(x.between(low, high)).alias("n_spike"), F.count_if((x > 3500) & (x <= 3600)).alias("n_cutoff")
    ).withColumn("spike_pct", F.coalesce(F.try_divide(F.col("n_spike"), F.col("n")) * 100, F.lit(0.0))).withColumn(
        "suspicious", (F.col("spike_pct") > limit_pct).cast("int"))


@dataclass(frozen=True)
class Check:
    """A counted condition and the severity steps by share of rows: (more than this share, severity)."""

    category: str
    name: str
    affected: Column
    steps: tuple[tuple[float, str], ...]


def validation_checks(columns: Sequence[str]) -> list[Check]:
    """The named checks whose columns the table has. Shares are fractions of all rows."""
    c = F.col
    # fixed values: check names, limits and severities as reports show them
    rows = [
        (("route_distance", "haversine"), Check("Distance", "Haversine Fallback Zeros", (c("route_distance") == 0) & (c("haversine") > 0), ((0, "CRITICAL"),))),
        (("route_distance",), Check("Distance", "Circular Route Wraparound", c("route_distance") > 20000, ((0, "HIGH"),))),
        (("route_distance",), Check("Distance", "Missing GTFS Trip Data", c("route_distance").isNull() | (c("route_distance") == 0), ((0.1, "HIGH"), (0, "MEDIUM")))),
        (("heading_change",), Check("Features", "Heading Change Unbounded", F.abs("heading_change") > 1800, ((0, "MEDIUM"),))),
        (("speed_mean",), Check("Features", "Rolling Feature NaN", c("speed_mean").isNull(), ((0.05, "MEDIUM"), (0, "LOW")))),
        (("is_class_change", "hour"), Check("Temporal", "Class Change Midnight Wraparound", ((c("hour") < 6) | (c("hour") > 22)) & (c("is_class_change") == 1), ((0, "MEDIUM"),))),
        (("scheduled_s",), Check("Temporal", "Scheduled Time Next-Day", c("scheduled_s") <= 0, ((0.05, "HIGH"), (0, "MEDIUM")))),
        (("minutes_since_stop",), Check("Temporal", "Minutes Since Stop Capped", c("minutes_since_stop") == 0, ((0.1, "LOW"),))),
        (("label_s",), Check("Labels", "Negative ETA Values", c("label_s") < 0, ((0, "CRITICAL"),))),
        (("label_s",), Check("Labels", "Label Outliers", c("label_s") > 3600, ((0.01, "MEDIUM"), (0, "LOW")))),
        (("label_s",), Check("Labels", "Join Success Rate", c("label_s").isNull() | (c("label_s") == 0), ((0.5, "HIGH"), (0.2, "MEDIUM")))),
        (("stop_id",), Check("Data Quality", "Stop Mapping Failures", c("stop_id").isNull(), ((0.05, "MEDIUM"), (0, "LOW")))),
        (("temperature_c", "precipitation_mm"), Check("Data Quality", "Weather FillNA Ambiguity", (c("temperature_c") == 20.0) & (c("precipitation_mm") == 0.0), ((0.1, "LOW"),))),
    ]
    return [check for needed, check in rows if all(n in columns for n in needed)]


def validation_suite(df: DataFrame) -> DataFrame:
    """One row per check: affected rows, share and severity; a single scan feeds every check."""
    checks = validation_checks(df.columns)
    aggregates = [F.count_if(F.coalesce(k.affected, F.lit(False))).alias(f"c{i}") for i, k in enumerate(checks)]
    special: list[tuple[str, str, Column, Column, Column]] = []
    if "label_s" in df.columns:
        aggregates.append(F.count_if((F.col("label_s") > 3500) & (F.col("label_s") <= 3600)).alias("cutoff"))
        near = F.col("cutoff")
        special.append(("Labels", "1-Hour Lookahead Bias", near, F.col("n"), F.when(near > 100, "HIGH").when(near > 0, "MEDIUM").otherwise("INFO")))
    if "acceleration" in df.columns:
        aggregates.append(F.max(F.abs("acceleration")).alias("accel"))
        low = F.when(F.col("accel") < 0.1, F.col("n")).otherwise(F.lit(0))
        special.append(("Features", "Acceleration Magnitude", low, F.col("n"), F.when(low > 0, "LOW").otherwise("INFO")))
    if "vehicle_id" in df.columns:
        aggregates.append(F.count_distinct("vehicle_id").alias("vehicles"))
        v = F.when(F.col("vehicles") > 50, F.col("vehicles")).otherwise(F.lit(0))
        special.append(("Data Quality", "Vehicle ID Mismatches", v, F.col("vehicles"), F.when(v > 0, "HIGH").otherwise("INFO")))
    holes = None
    for c in df.columns:
        hole = F.count_if(F.col(c).isNull())
        holes = hole if holes is None else holes + hole
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggregates, holes.alias("holes"))
    cells = F.col("n") * len(df.columns)
    special.append(("Data Quality", "Feature Completeness", F.col("holes"), cells,
                    F.when(F.col("holes") > cells * 0.05, "MEDIUM").when(F.col("holes") > 0, "LOW").otherwise("INFO")))
    found = []
    for i, check in enumerate(checks):
        hit = F.col(f"c{i}")
        severity = F.when(F.lit(False), F.lit(None))
        for share, level in check.steps:
            severity = severity.when(hit > F.col("n") * share, level)
        found.append((check.category, check.name, hit, F.col("n"), severity.otherwise("INFO")))
    structs = [
        F.struct(F.lit(cat).alias("category"), F.lit(name).alias("check"), hit.cast("long").alias("affected"),
                 total.cast("long").alias("total"), sev.alias("severity"))
        for cat, name, hit, total, sev in [*found, *special]
    ]
    return row.select(F.explode(F.array(*structs)).alias("_c")).select("_c.*")


def severity_summary(findings: DataFrame) -> DataFrame:
    """Category x severity counts."""
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    return findings.groupBy("category").pivot("severity", levels).agg(F.count(F.lit(1))).select(
        "category", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in levels])


def telemetry_issue_flags(df: DataFrame, arrivals: DataFrame, keys: Sequence[str] = ("vehicle_id",), reach_ms: int = DEFAULTS.strict_tolerance_ms,
                          stale_ms: int = 30_000, jump_slack_s: float = 120.0) -> DataFrame:
    """Six issue flags per ping (see the report that sums them)."""
    prev = lag_across(df, keys, "ts_ms", ("ts_ms", "event_id"), {
        "_stop": "next_stop_id", "_eta": "eta_minutes", "_ts": "ts_ms", "_speed": "speed"})
    local = F.pmod(F.col("ts_ms") + DEFAULTS.local_offset_h * HOUR_MS, F.lit(86_400_000)) / F.lit(60_000.0)
    eta_s = (F.col("eta_minutes") - local) * 60
    elapsed = (F.col("ts_ms") - F.col("_ts")) / F.lit(1000.0)
    asked = prev.withColumn("_prev_stop", F.col("_stop"))
    # the arrival at the previous next stop that follows the previous ping
    given = arrivals.select(*keys, F.col("stop_id").alias("_prev_stop"), "arrival_ms")
    matched = asof_next(asked, given, [*keys, "_prev_stop"], "_ts", "arrival_ms", reach_ms, "_true_ms", strict=True)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    changed = F.col("_stop") != F.col("next_stop_id")
    same = F.col("_stop") == F.col("next_stop_id")
    return matched.select(
        *df.columns,
        flag((F.col("eta_minutes") > 0) & (eta_s < 0)).alias("negative_eta"),
        flag(same & (F.abs(F.col("eta_minutes") - F.col("_eta")) * 60 > elapsed + jump_slack_s)).alias("large_eta_jump"),
        flag(changed & (F.col("ts_ms") < F.col("_true_ms"))).alias("stop_transition_mismatch"),
        flag((F.col("speed") == 0) & (F.col("_speed") == 0) & (F.col("ts_ms") - F.col("_ts") > stale_ms)).alias("stale_position"),
        flag(same & (F.col("ts_ms") > F.col("_true_ms"))).alias("eta_after_arrival"),
        flag(eta_s > 1800).alias("impossible_eta"),
    )


# fixed values: issue names as reports show them
ISSUES = ("negative_eta", "large_eta_jump", "stop_transition_mismatch", "stale_position", "eta_after_arrival", "impossible_eta")


def telemetry_issues(flagged: DataFrame) -> DataFrame:
    """Counts per issue and the share of pings without any."""
    any_issue = F.greatest(*[F.col(i) for i in ISSUES])
    return flagged.agg(
        F.count(F.lit(1)).alias("total_records"), *[F.sum(i).cast("long").alias(i) for i in ISSUES],
        F.count_if(any_issue == 0).alias("valid_records"), (F.avg((any_issue == 0).cast("int")) * 100).alias("valid_pct"))


def issue_examples(flagged: DataFrame, k: int = 3) -> DataFrame:
    """The earliest ``k`` pings per issue (a report)."""
    tall = flagged.select("event_id", "ts_ms", *ISSUES).unpivot(["event_id", "ts_ms"], list(ISSUES), "issue", "hit").where("hit = 1")
    # each time slice keeps its own first k before the few survivors are ranked
    local = tall.withColumn("_s", floor_div("ts_ms", HOUR_MS)).withColumn(
        "_r", F.row_number().over(Window.partitionBy("issue", "_s").orderBy("ts_ms", "event_id"))).where(F.col("_r") <= k)
    rank = F.row_number().over(Window.partitionBy("issue").orderBy("ts_ms", "event_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("issue", "rank", "event_id", "ts_ms")


def mismatch_cases(marks: DataFrame, arrivals: DataFrame, keys: Sequence[str], reach_ms: int, before_ms: int, after_ms: int) -> DataFrame:
    """Transitions where the next arrival after the last ping and the nearest one in the window disagree."""
    nxt = asof_next(marks, arrivals, [*keys, "stop_id"], "prev_ts_ms", "arrival_ms", reach_ms, "next_ms", strict=True)
    near = match_event_window(nxt, arrivals, [*keys, "stop_id"], "ts_ms", "arrival_ms", before_ms, after_ms, output="near_ms")
    return near.where(~F.col("next_ms").eqNullSafe(F.col("near_ms")))


def status_profile(df: DataFrame, status: str = "status", example: str = "vehicle_name") -> DataFrame:
    """Rows per status code with three example vehicles (smallest names; distinct pairs merge first)."""
    pairs = df.groupBy(status, example).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(status).orderBy(example))
    ranked = pairs.withColumn("_r", rank)
    return ranked.groupBy(status).agg(
        F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.col(example)))).alias("examples"))


def clock_lag(df: DataFrame, server_ms: str, vehicle_ms: str) -> DataFrame:
    lag = (F.col(server_ms) - F.col(vehicle_ms)) / F.lit(1000.0)
    return df.agg(F.avg(lag).alias("mean_lag_s"), F.min(lag).alias("min_lag_s"), F.max(lag).alias("max_lag_s"), F.count(lag).alias("n"))


def eta_unit_test(df: DataFrame, stops: str, psid: str, seta: str) -> DataFrame:
    """How often the scheduled ETA equals the listed time of its pattern stop."""
    hit = F.get(F.filter(stops, lambda s: s["psid"] == F.col(psid)), F.lit(0))["time"]
    return df.agg(F.count_if(hit == F.col(seta)).alias("matches"), F.count_if(hit != F.col(seta)).alias("mismatches"))


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    """Columns by the prefix before their first underscore (schema only, no job)."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        groups.setdefault(name.split("_")[0] if "_" in name else "root", []).append(name)
    return groups


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule, one aggregate."""
    row = df.agg(*[F.count_if(F.coalesce(~ok, F.lit(True))).alias(n) for n, ok in rules.items()])
    return row.unpivot([], list(rules), "rule", "n_violations")


def assert_invariants(df: DataFrame, rules: dict[str, Column]) -> None:
    """Fail the stage when a rule is broken (collects one row of counts)."""
    broken = {r["rule"]: r["n_violations"] for r in violations(df, rules).where("n_violations > 0").collect()}
    if broken:
        raise AssertionError(f"stage invariants broken: {broken}")


# fixed values: report thresholds
LIMITS = {"label_missing_rate": 30.0, "speed_out_of_range_rate": 1.0, "weather_missing_rate": 5.0, "labels_negative": 0.0, "missing_expected_features": 0.0}


def quality_report(values: DataFrame, expected: Sequence[str] = (), present: Sequence[str] = ()) -> DataFrame:
    """(name, value, threshold, ok, warning): values against their thresholds, with a text for each that exceeds its own.

    ``expected``: the features a table must have, of which those not ``present`` are counted and named. Values without a threshold are
    reported as they are; an unknown (NULL) value is no warning.
    """
    missing = sorted(set(expected) - set(present))
    rows = values.select("name", F.col("value").cast("double").alias("value"))
    if expected:
        rows = rows.unionByName(rows.sparkSession.range(1).select(F.lit("missing_expected_features").alias("name"), F.lit(float(len(missing))).alias("value")))
    limit = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    named = rows.withColumn("threshold", F.try_element_at(limit, F.col("name")))
    over = F.coalesce(F.col("value") > F.col("threshold"), F.lit(False))
    text = F.when(F.col("name") == "missing_expected_features", F.lit("missing expected features: " + ", ".join(missing)))
    text = text.when(F.col("name") == "labels_negative", F.format_string("%.0f negative labels found", "value"))
    text = text.otherwise(F.format_string("%s of %.3f%% exceeds the threshold of %.1f%%", "name", "value", "threshold"))
    return named.withColumn("ok", (~over).cast("int")).withColumn("warning", F.when(over, text))


def eta_seconds_with_flag(df: DataFrame, field: str, ts: str, output: str) -> DataFrame:
    left, valid = minutes_of_day_to_eta(field, ts)
    return df.withColumn(output, left).withColumn(f"has_{output}", valid)


def approach_summary(errors: DataFrame, limits: Sequence[int] = (30, 60, 90, 120, 180, 300)) -> DataFrame:
    """What an ETA said at the start of an approach against the arrival: median, direction and shares within limits, in one row."""
    from pingloom.operators import metrics
    from pingloom.operators.quantiles import grouped_quantiles

    median = grouped_quantiles(errors, [], "abs_err", {"median_ae": 0.5}, "n")
    sides = metrics.directional(errors).select(F.struct("overestimate_rate", "overestimate_mae", "underestimate_mae").alias("s")).scalar()
    near = metrics.within_thresholds(errors, limits, ())
    shares = near.select(F.struct(*near.columns).alias("s")).scalar()
    return median.select("n", "median_ae", *[sides[c].alias(c) for c in ("overestimate_rate", "overestimate_mae", "underestimate_mae")], *[shares[c].alias(c) for c in near.columns])
