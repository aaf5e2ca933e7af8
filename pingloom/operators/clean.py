"""Filters, their reports and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS, Box
from pingloom.operators.quantiles import grouped_quantiles


def in_box(box: Box = DEFAULTS.box, lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).between(box.lat_min, box.lat_max) & F.col(lon).between(box.lon_min, box.lon_max)


def slow_enough(limit: float = DEFAULTS.max_speed_mph, speed: str = "speed") -> Column:
    return F.col(speed) <= limit


def regular_vehicle(pattern: str = DEFAULTS.vehicle_name_pattern, name: str = "vehicle_name") -> Column:
    """A missing name matches no pattern, so the row stays."""
    return ~F.coalesce(F.col(name).rlike(pattern), F.lit(False)) & ~F.col(name).eqNullSafe("")


def _not_in(column: str, values: Sequence) -> Column:
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def _not(column: str, value) -> Column:
    return ~F.col(column).eqNullSafe(value)


def regular_service(cfg=DEFAULTS) -> Column:
    """A missing pattern, route or progress is none of the excluded ones."""
    return _not("pattern_id", cfg.idle_pattern_id) & _not_in("route_id", cfg.excluded_routes) & _not("progress", -1)


def cleaning_rules(cfg=DEFAULTS) -> dict[str, Column]:
    """The ingest rules in report order. A missing place or speed fails its rule; any other missing value passes."""
    return {
        "bbox": F.coalesce(in_box(cfg.box), F.lit(False)),
        "speed": F.coalesce(slow_enough(cfg.max_speed_mph), F.lit(False)),
        "vid": regular_vehicle(cfg.vehicle_name_pattern),
        "pattern": _not("pattern_id", cfg.idle_pattern_id),
        "route": _not_in("route_id", cfg.excluded_routes),
        "progress": _not("progress", -1),
    }


def filter_bbox(df: DataFrame, box: Box = DEFAULTS.box) -> DataFrame:
    return df.where(in_box(box))


def filter_speed(df: DataFrame, limit: float = DEFAULTS.max_speed_mph) -> DataFrame:
    return df.where(slow_enough(limit))


def filter_vehicles(df: DataFrame, keep_prefix: str | None = None) -> DataFrame:
    kept = df.where(regular_vehicle())
    return kept.where(F.col("vehicle_name").startswith(keep_prefix)) if keep_prefix else kept


def filter_service(df: DataFrame, cfg=DEFAULTS) -> DataFrame:
    return df.where(regular_service(cfg))


def filter_active_trips(df: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Each clause applies only where its column exists."""
    clauses = {
        "status": F.col("status").isin(*cfg.active_status),
        "pattern_id": _not("pattern_id", cfg.idle_pattern_id),
        "next_stop_id": F.col("next_stop_id").isNotNull() & (F.col("next_stop_id") != 0),
    }
    for column, clause in clauses.items():
        if column in df.columns:
            df = df.where(clause)
    return df


def filter_idle(df: DataFrame, cfg=DEFAULTS) -> DataFrame:
    """Rows that stand still, have no next trip or are on an idle route go; a missing value proves none of that."""
    return df.where(
        ~(F.col("progress").eqNullSafe(0) & F.col("speed").eqNullSafe(0))
        & _not("next_stop_id", 0)
        & _not_in("route_id", cfg.idle_routes)
    )


def filter_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Removals per rule, in total, and rows kept: one aggregate over one scan."""
    every = F.lit(True)
    for rule in rules.values():
        every = every & rule
    return df.agg(
        *[F.count_if(~rule).alias(name) for name, rule in rules.items()],
        F.count_if(~every).alias("total_removed"),
        F.count_if(every).alias("kept"),
    )


def verify_filters(before: DataFrame, after: DataFrame, cfg=DEFAULTS, fail: bool = False) -> DataFrame:
    """Row counts, retention, the number of rows that should not have survived and their vehicles (at most the fleet).

    With ``fail`` a survivor ends the job, naming the vehicles.
    """
    n_before = before.agg(F.count(F.lit(1)).alias("rows_before")).scalar()
    bad = F.coalesce(F.col("vehicle_name").rlike(cfg.vehicle_name_pattern), F.lit(False)) | F.col("pattern_id").eqNullSafe(cfg.idle_pattern_id)
    found = after.agg(
        F.count(F.lit(1)).alias("rows_after"), F.count_if(bad).alias("survivors"),
        F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("vehicle_name")))), ",").alias("vehicles"),
    )
    if fail:
        complaint = F.raise_error(F.concat(F.lit("excluded vehicles survived the filters: "), "vehicles")).cast("long")
        found = found.withColumn("survivors", F.when(F.col("survivors") > 0, complaint).otherwise(F.col("survivors")))
    return found.select(
        n_before.alias("rows_before"), "rows_after", "survivors", "vehicles",
        (F.try_divide(n_before - F.col("rows_after"), n_before) * 100).alias("excluded_pct"),
        (F.try_divide(F.col("rows_after"), n_before) * 100).alias("retained_pct"),
    )


def label_stages(label: str, low: float = DEFAULTS.label_min_s, high: float = DEFAULTS.label_max_s) -> dict[str, Column]:
    x = F.col(label)
    return {
        "no_match": x.isNull(),
        "not_positive": x <= 0,
        "too_close": (x > 0) & (x <= low),
        "too_far": x > high,
    }


def filter_labels(df: DataFrame, label: str, low: float = DEFAULTS.label_min_s, high: float = DEFAULTS.label_max_s) -> DataFrame:
    return df.where((F.col(label) > low) & (F.col(label) <= high))


def filter_labels_report(df: DataFrame, label: str, low: float = DEFAULTS.label_min_s, high: float = DEFAULTS.label_max_s) -> DataFrame:
    """Rows each stage drops; the stages are disjoint, so the counts add up."""
    stages = label_stages(label, low, high)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in stages.items()],
        F.count_if((F.col(label) > low) & (F.col(label) <= high)).alias("kept"),
    )


def trim_by_group_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = DEFAULTS.label_quantile) -> DataFrame:
    """Drop rows above their own group's quantile."""
    limits = grouped_quantiles(df, keys, value, {"_limit": q})
    return df.join(limits, list(keys)).where(F.col(value) <= F.col("_limit")).select(*df.columns)


def trim_zscore(df: DataFrame, value: str, limit: float = 2.5) -> DataFrame:
    """Keep rows within ``limit`` population standard deviations of the mean."""
    fit = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).alias("fit")).scalar()
    return df.where(F.abs(F.try_divide(F.col(value) - fit["m"], fit["s"])) <= limit)
