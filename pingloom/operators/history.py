"""Historical aggregates and the joins that attach them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS
from pingloom.functions.scalars import clip
from pingloom.operators.dictionary import folded, found
from pingloom.operators.joins import lookup_left
from pingloom.operators.quantiles import grouped_quantiles
from pingloom.operators.summaries import merged_moments, merged_quantiles
from pingloom.plans.stages import materialize

CELL = ("route_id", "last_stop_id", "hour_ct", "day_type")


def quartile_cells(df: DataFrame, keys: Sequence[str], value: str, prefix: str, min_obs: int = DEFAULTS.history_min_obs) -> DataFrame:
    """Median and quartiles per cell; a sparse cell keeps its row with NULL statistics."""
    return _with_enough(grouped_quantiles(df, keys, value, _quartiles(prefix), "n"), keys, prefix, min_obs)


def quartile_cells_from_days(summary: DataFrame, keys: Sequence[str], prefix: str, min_obs: int = DEFAULTS.history_min_obs) -> DataFrame:
    """The same cells from daily summaries (:mod:`pingloom.operators.summaries`): a refit summarises the new day only."""
    return _with_enough(merged_quantiles(summary, keys, _quartiles(prefix)), keys, prefix, min_obs)


def _quartiles(prefix: str) -> dict[str, float]:
    return {f"{prefix}_median": 0.5, f"{prefix}_p25": 0.25, f"{prefix}_p75": 0.75}


def _with_enough(q: DataFrame, keys: Sequence[str], prefix: str, min_obs: int) -> DataFrame:
    enough = F.col("n") >= min_obs
    return q.select(*keys, *[F.when(enough, F.col(c)).alias(c) for c in _quartiles(prefix)], "n")


def hist_segments(travel: DataFrame, min_obs: int = DEFAULTS.history_min_obs) -> DataFrame:
    return quartile_cells(travel, CELL, "segment_s", "segment_travel", min_obs)


def hist_dwells(dwells: DataFrame, min_obs: int = DEFAULTS.history_min_obs) -> DataFrame:
    return quartile_cells(dwells, ("route_id", "stop_id", "hour_ct", "day_type"), "dwell_s", "dwell", min_obs)


def hist_speed(pings: DataFrame, speed: str = "gps_speed_mps", min_obs: int = DEFAULTS.history_min_obs) -> DataFrame:
    q = grouped_quantiles(pings, CELL, speed, {"hist_speed_median": 0.5}, "n")
    return q.select(*CELL, F.when(F.col("n") >= min_obs, F.col("hist_speed_median")).alias("hist_speed_median"))


def speed_ratio(df: DataFrame, lookup: DataFrame, speed: str = "gps_speed_mps") -> DataFrame:
    """Speed against the cell's median; NULL where that is unknown or not positive."""
    joined = df.join(lookup, list(CELL), "left")
    ratio = F.when(F.col("hist_speed_median") > 0, F.try_divide(F.col(speed), F.col("hist_speed_median")))
    return joined.select(*df.columns, ratio.alias("speed_ratio"))


def segment_times(travel: DataFrame, keys: Sequence[str] = ("route_id", "prev_station", "station", "hour"), max_s: float = 3600.0) -> DataFrame:
    valid = travel.where((F.col("travel_s") > 0) & (F.col("travel_s") < max_s))
    return valid.groupBy(*keys).agg(
        F.avg("travel_s").alias("mean_s"), F.coalesce(F.stddev_samp("travel_s"), F.lit(0.0)).alias("std_s"), F.count(F.lit(1)).alias("n")
    )


def stop_dwell(arrivals: DataFrame, dwell: str = "dwell_s", keys: Sequence[str] = ("station", "hour"), max_s: float = 600.0) -> DataFrame:
    """Mean dwell per stop and hour; texts that are no numbers are ignored."""
    d = F.col(dwell).cast("string").try_cast("double")
    return arrivals.select(*keys, d.alias("_d")).where((F.col("_d") > 0) & (F.col("_d") < max_s)).groupBy(*keys).agg(
        F.avg("_d").alias("mean_s"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("std_s"), F.count(F.lit(1)).alias("n")
    )


def moment_cells_from_days(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, deviation (0 for one value) and number per cell, as :func:`segment_times` and :func:`stop_dwell` have them, from days."""
    return merged_moments(summary, keys).select(*keys, F.col("mean").alias("mean_s"), F.coalesce("std", F.lit(0.0)).alias("std_s"), "n")


def vehicle_speed_factor_from_days(summary: DataFrame) -> DataFrame:
    """As :func:`vehicle_speed_factor`, from daily summaries of the travel times by vehicle."""
    per = merged_moments(summary, ["vehicle_id"])
    fleet = per.agg((F.sum("total") / F.sum("n")).alias("m")).scalar()
    return per.select("vehicle_id", clip(fleet / F.col("mean"), 0.5, 2.0).alias("speed_factor"))


def vehicle_speed_factor(travel: DataFrame, max_s: float = 3600.0) -> DataFrame:
    """Fleet mean travel time over the vehicle's, clamped to 0.5..2; both from one pass of partial sums."""
    per = travel.where((F.col("travel_s") > 0) & (F.col("travel_s") < max_s)).groupBy("vehicle_id").agg(
        F.sum("travel_s").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    fleet = per.agg((F.sum("_sum") / F.sum("_n")).alias("m")).scalar()
    return per.select("vehicle_id", clip(fleet / (F.col("_sum") / F.col("_n")), 0.5, 2.0).alias("speed_factor"))


def join_historical(df: DataFrame, segments: DataFrame, dwells: DataFrame, factors: DataFrame) -> DataFrame:
    """The three lookups with their defaults 0, 0, 0 and 1."""
    seg = segments.select(
        "route_id", F.col("prev_station").alias("last_station"), F.col("station").alias("target_station"), "hour",
        F.col("mean_s").alias("_seg_mean"), F.col("std_s").alias("_seg_std"))
    dwl = dwells.select(F.col("station").alias("target_station"), "hour", F.col("mean_s").alias("_dwell"))
    out = lookup_left(df, seg, ["route_id", "last_station", "target_station", "hour"])
    out = lookup_left(out, dwl, ["target_station", "hour"])
    out = lookup_left(out, factors, ["vehicle_id"])
    return out.select(
        *df.columns,
        F.coalesce("_seg_mean", F.lit(0.0)).alias("segment_avg_travel_time_sec"),
        F.coalesce("_seg_std", F.lit(0.0)).alias("segment_std_travel_time_sec"),
        F.coalesce("_dwell", F.lit(0.0)).alias("stop_avg_dwell_time_sec"),
        F.coalesce("speed_factor", F.lit(1.0)).alias("vehicle_speed_factor"),
    )


def route_progress_distance(df: DataFrame, stop_seq: DataFrame) -> DataFrame:
    """Distance still to go: shape difference when positive, else progress difference x route length."""
    last = stop_seq.select("route_id", F.col("stop_id").alias("last_stop_id"), F.col("shape_dist").alias("_last_dist"))
    target = stop_seq.select("route_id", F.col("stop_id").alias("target_stop_id"), F.col("shape_dist").alias("_target_dist"))
    length = stop_seq.groupBy("route_id").agg(F.max("max_dist").alias("_length"))
    joined = (
        lookup_left(lookup_left(df, last, ["route_id", "last_stop_id"]), target, ["route_id", "target_stop_id"])
        .join(length, "route_id", "left")
    )
    by_shape = F.col("_target_dist") - F.col("_last_dist")
    by_progress = (F.col("target_stop_progress") - F.col("progress")) * F.col("_length")
    return joined.select(*df.columns, F.when(by_shape > 0, by_shape).when(by_progress > 0, by_progress).alias("way"))


S2S_TIER1 = ("route_id", "last_stop_id", "target_stop_id", "hour_ct", "day_type")
S2S_TIER2 = ("route_id", "last_stop_id", "target_stop_id", "day_type")
S2S_TIER3 = ("route_id", "day_type")


def s2s_tiers(train: DataFrame, label: str = "label_s", min_obs: int = DEFAULTS.tier_min_obs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stop-to-stop lookups: mean by hour cell, mean without the hour, median pace per route and day type.

    ``train`` carries ``way`` from :func:`route_progress_distance`. The second tier sums the partial
    sums of the first, so the rows themselves are shuffled once for both.
    """
    sums = train.groupBy(*S2S_TIER1).agg(F.sum(label).alias("_s"), F.count(label).alias("_c"))
    tier1 = sums.where(F.col("_c") >= min_obs).select(*S2S_TIER1, (F.col("_s") / F.col("_c")).alias("t1"))
    tier2 = (
        sums.groupBy(*S2S_TIER2).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        .where(F.col("_c") >= min_obs).select(*S2S_TIER2, (F.col("_s") / F.col("_c")).alias("t2"))
    )
    pace = train.where(F.col("way") > 0).withColumn("_pace", F.try_divide(F.col(label), F.col("way")))
    tier3 = grouped_quantiles(pace, S2S_TIER3, "_pace", {"t3": 0.5}, "_c").where(F.col("_c") >= min_obs).drop("_c")
    return tier1, tier2, tier3


def apply_s2s(df: DataFrame, tiers: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Mean of the most specific known cell, else way x median pace; plus the tier that answered."""
    first, second, pace = tiers
    # both stop-to-stop tiers in one join (their cells folded by stops), the route's pace in another
    cells = first.select(*S2S_TIER1, F.col("t1").alias("t"), F.lit(0).alias("_tier")).unionByName(
        second.select(*S2S_TIER2, F.col("t2").alias("t"), F.lit(1).alias("_tier")), allowMissingColumns=True)
    joined = df.join(folded(cells, S2S_TIER1[:3], [S2S_TIER1[3:], S2S_TIER2[3:]], ["t"]), list(S2S_TIER1[:3]), "left")
    joined = joined.withColumns({"t1": found("_dict", 0, S2S_TIER1[3:])["t"], "t2": found("_dict", 1, S2S_TIER2[3:])["t"]}).join(pace, list(S2S_TIER3), "left")
    by_pace = F.col("way") * F.col("t3")
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(by_pace.isNotNull(), 3).otherwise(0)
    return joined.select(*df.columns, F.coalesce("t1", "t2", by_pace).alias("baseline_s2s"), tier.alias("s2s_tier"))


def prorated_segments(stop_seq: DataFrame, travel: DataFrame, min_obs: int = DEFAULTS.prorated_min_obs) -> DataFrame:
    """Per route, day type and stop: the arriving segment's median with its fallbacks, cumulated along the route."""
    # both levels in one pass: each row counts for its day type and for all of them
    levels = F.explode(F.array(F.struct(F.lit(False).alias("_all"), F.col("day_type")), F.struct(F.lit(True).alias("_all"), F.lit(None).cast(travel.schema["day_type"].dataType).alias("day_type"))))
    rows = travel.select("route_id", "last_stop_id", "segment_s", levels.alias("_v")).select("route_id", "last_stop_id", "segment_s", "_v.*")
    fitted = materialize(grouped_quantiles(rows, ["route_id", "last_stop_id", "_all", "day_type"], "segment_s", {"_m": 0.5}, "_n").where(F.col("_n") >= min_obs))
    by_day = fitted.where(~F.col("_all")).select("route_id", "last_stop_id", "day_type", F.col("_m").alias("_day"))
    any_day = fitted.where("_all").select("route_id", "last_stop_id", F.col("_m").alias("_any"))
    route = any_day.groupBy("route_id").agg(F.avg("_any").alias("_route"))
    stops = stop_seq.withColumn("day_type", F.explode(F.array(F.lit(0), F.lit(1))))
    rename = lambda df: df.withColumnRenamed("last_stop_id", "stop_id")
    cells = (
        stops.join(rename(by_day), ["route_id", "stop_id", "day_type"], "left")
        .join(rename(any_day), ["route_id", "stop_id"], "left").join(route, "route_id", "left")
        .withColumn("seg_s", F.coalesce("_day", "_any", "_route", F.lit(60.0)))
    )
    line = Window.partitionBy("route_id", "day_type").orderBy("stop_sequence", "stop_id")  # stops of one route
    at = F.row_number().over(line)
    return cells.select(
        "route_id", "day_type", "stop_id", "shape_dist", "max_dist", "seg_s", at.alias("idx"),
        F.lag("shape_dist").over(line).alias("prev_dist"),
        (F.sum("seg_s").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.first("seg_s").over(line)).alias("cum_s"),
    )


def prorated_baseline(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of the current segment still ahead x its median, plus all following segments to the target."""
    last = segments.select("route_id", "day_type", F.col("stop_id").alias("last_stop_id"), F.struct(
        "idx", "cum_s", "seg_s", "shape_dist", "prev_dist", "max_dist").alias("_l"))
    target = segments.select("route_id", "day_type", F.col("stop_id").alias("target_stop_id"), F.struct("idx", "cum_s").alias("_t"))
    joined = df.join(last, ["route_id", "day_type", "last_stop_id"], "left").join(target, ["route_id", "day_type", "target_stop_id"], "left")
    length = F.col("_l.shape_dist") - F.col("_l.prev_dist")
    left = F.greatest(F.lit(0.0), F.col("_l.shape_dist") - F.col("progress") * F.col("_l.max_dist"))
    share = F.when(length > 0, F.least(F.lit(1.0), F.try_divide(left, length))).otherwise(F.lit(0.5))
    current = F.when(F.col("_l.idx") > 1, share * F.col("_l.seg_s")).otherwise(F.lit(0.0))
    value = F.when(F.col("_t.idx") >= F.col("_l.idx"), current + F.col("_t.cum_s") - F.col("_l.cum_s"))
    return joined.select(*df.columns, value.alias("baseline_prorated"))


def active_vehicle_counts(routes: DataFrame, positions: DataFrame) -> DataFrame:
    """Vehicles per route and the display order: active routes first, then by name."""
    per = positions.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_vehicles"))
    counted = routes.join(per, "route_id", "left").withColumn("n_vehicles", F.coalesce("n_vehicles", F.lit(0)))
    # the route list is a network dimension; its order is presentation
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("n_vehicles") == 0).cast("int"), "long_name", "route_id")
    return counted.withColumn("position", F.row_number().over(order))


def cell_coverage(cells: DataFrame, value: str, min_obs: int = DEFAULTS.history_min_obs) -> DataFrame:
    """Valid and sparse cells and the range of the valid values."""
    valid = F.col("n") >= min_obs
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_sparse"),
        F.min(F.when(valid, F.col(value))).alias("min_value"), F.max(F.when(valid, F.col(value))).alias("max_value"),
        F.avg(F.when(valid, F.col(value))).alias("mean_value"),
    )
