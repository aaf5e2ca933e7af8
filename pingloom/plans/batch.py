"""The batch chain: clean, fan out, label, split, fit baselines, score.

Each stage is a function of DataFrames; what several later stages read is written once (see
``stages.materialize``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS, Thresholds
from pingloom.functions.times import epoch_day, weekday
from pingloom.operators import clean, history, tiers
from pingloom.operators.events import downsample_last
from pingloom.operators.joins import label_stops_ahead, lookup_left
from pingloom.operators.metrics import regression_metrics, with_errors
from pingloom.operators.model import fit_gbt, score
from pingloom.operators.splits import temporal_split
from pingloom.plans.stages import materialize


@dataclass(frozen=True)
class BatchInputs:
    pings: DataFrame
    arrivals: DataFrame
    stop_seq: DataFrame


def clean_pings(pings: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    keep = F.lit(True)
    for rule in clean.cleaning_rules(cfg).values():
        keep = keep & rule
    return clean.filter_idle(pings.where(keep), cfg)


def label_stage(pings: DataFrame, arrivals: DataFrame, stop_seq: DataFrame, cfg: Thresholds = DEFAULTS, k: int = 8) -> DataFrame:
    """Downsampled pings x the stops ahead, labelled; pings are fanned out after they have met the arrivals."""
    labeled = label_stops_ahead(
        downsample_last(pings).drop("bucket_ms"), arrivals, stop_seq, "ts_ms", "arrival_ms", cfg.asof_tolerance_ms, "actual_arrival_ms", k,
    ).withColumn("label_s", (F.col("actual_arrival_ms") - F.col("ts_ms")) / F.lit(1000.0))
    # written once: the quantile and the trim below read the labelled rows, not the join again
    kept = materialize(clean.filter_labels(labeled, "label_s", cfg.label_min_s, cfg.label_max_s))
    return clean.trim_by_group_quantile(kept, ["route_id"], "label_s", cfg.label_quantile)


def split_stage(labeled: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    dated = labeled.withColumn("day", epoch_day("ts_ms")).withColumn("day_type", (weekday("ts_ms") < 5).cast("int")).withColumn(
        "hour_ct", F.pmod(F.floor(F.col("ts_ms") / 3_600_000) + DEFAULTS.local_offset_h, F.lit(24)).cast("int"))
    return temporal_split(dated, "day", ranges)


def with_last_progress(rows: DataFrame, stop_seq: DataFrame) -> DataFrame:
    last = stop_seq.select("route_id", F.col("stop_id").alias("last_stop_id"), F.col("stop_progress").alias("last_stop_progress"))
    return lookup_left(rows, last, ["route_id", "last_stop_id"])


def baseline_stage(train: DataFrame, rows: DataFrame, stop_seq: DataFrame, config: tiers.TierConfig = tiers.BASELINE,
                   output: str = "baseline") -> DataFrame:
    """Both baselines fitted on ``train`` and applied to ``rows``: stop-to-stop is the cascade's last resort.

    The fitted cells are a table, written once by tier: each of the cascade's joins reads its own
    part with a known size instead of fitting again.
    """
    far = lambda df: history.route_progress_distance(df, stop_seq)
    edges = tiers.quantile_bins_fit(train, tiers.elapsed_seconds())
    cells = materialize(tiers.tier_fit(tiers.with_tier_bins(train, edges), config), partition_by=["_tier"])
    with_s2s = history.apply_s2s(far(rows), history.s2s_tiers(far(train)))
    return tiers.tier_apply(tiers.with_tier_bins(with_s2s, edges), cells, config, "baseline_s2s", output)


def scored_stage(inputs: BatchInputs, ranges: dict[str, tuple[int, int]], wanted: Sequence[str], cfg: Thresholds = DEFAULTS, k: int = 8) -> DataFrame:
    """Labelled rows of the ``wanted`` splits with the baselines fitted on the training range, written."""
    stop_seq = materialize(inputs.stop_seq)
    labeled = with_last_progress(label_stage(clean_pings(inputs.pings, cfg), inputs.arrivals, stop_seq, cfg, k), stop_seq)
    split = materialize(split_stage(labeled, ranges), partition_by=["split"])
    return materialize(baseline_stage(split.where("split = 'train'"), split.where(F.col("split").isin(*wanted)), stop_seq))


def run_batch(inputs: BatchInputs, ranges: dict[str, tuple[int, int]], cfg: Thresholds = DEFAULTS, k: int = 8) -> DataFrame:
    """Error of the baseline on the test range, per route."""
    scored = scored_stage(inputs, ranges, ["test"], cfg, k)
    return regression_metrics(with_errors(scored.where("baseline IS NOT NULL"), "label_s", "baseline"), ["route_id"], "label_s")


# what is known of a row when it is scored; the label's own times are not among them
MODEL_INPUTS = ("baseline", "baseline_s2s", "progress", "target_stop_progress", "last_stop_progress", "stops_away", "speed", "heading", "passenger_load", "last_stop_on_time", "hour_ct", "day_type")


def run_batch_model(inputs: BatchInputs, ranges: dict[str, tuple[int, int]], cfg: Thresholds = DEFAULTS, k: int = 8, columns: Sequence[str] = MODEL_INPUTS, trees: int = 20, depth: int = 5) -> DataFrame:
    """The chain with the model on top of the baseline: boosted trees learn what the baseline misses in the training range, stop early
    on the validation range, and both are scored on the test range. Per route: n, baseline_mae, model_mae, improvement_pct, wins (the
    share of rows on which the model is closer). Without training rows the baseline stands; without validation rows no fit stops early."""
    scored = scored_stage(inputs, ranges, ["train", "val", "test"], cfg, k).where("baseline IS NOT NULL").withColumn("residual", F.col("label_s") - F.col("baseline"))
    known = [c for c in columns if c in scored.columns]
    held = scored.where("split = 'test'").select("route_id", "label_s", *known)
    rows = {r["split"]: r["n"] for r in scored.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if rows.get("train"):
        parts = scored.where("split <> 'test'").select(*known, "residual", (F.col("split") == "val").alias("is_val"))
        out = score(held, fit_gbt(parts, known, "residual", "is_val" if rows.get("val") else None, trees, depth), known)
    else:  # nothing to learn from: the baseline stands
        out = held.withColumn("predicted", F.col("baseline"))
    base, model = F.abs(F.col("label_s") - F.col("baseline")), F.abs(F.col("label_s") - F.col("predicted"))
    per = out.groupBy("route_id").agg(F.count("*").alias("n"), F.avg(base).alias("baseline_mae"), F.avg(model).alias("model_mae"), F.avg((model < base).cast("int")).alias("wins"))
    return per.withColumn("improvement_pct", F.try_divide(F.col("baseline_mae") - F.col("model_mae"), F.col("baseline_mae")) * 100)
