"""Ordered fallback: the most specific cell with enough observations answers.

All tiers are fitted in one pass: each training row is expanded once per tier, with the columns a
tier does not use set to NULL, and one grouped aggregation yields every lookup. Applying them is
one left join: the cells of all tiers are folded into one row per combination of the keys that all
tiers share, and the fallback is walked inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS
from pingloom.functions.scalars import bin_index, is_stopped, on_time_bin, on_time_bin3, segment_decile
from pingloom.operators.dictionary import folded, found
from pingloom.operators.quantiles import grouped_quantiles
from pingloom.operators.summaries import daily, merged_moments, merged_quantiles
from pingloom.plans.stages import materialize

STOPS = ("route_id", "last_stop_id", "target_stop_id")


@dataclass(frozen=True)
class Tier:
    name: str
    keys: tuple[str, ...]
    needs_elapsed: bool = False
    elapsed: str = "elapsed_decile"  # the column that tells whether the elapsed time is known

    def by(self, elapsed: str) -> Tier:
        """The same tier over other bins of the elapsed time."""
        return Tier(self.name, tuple(elapsed if k == E else k for k in self.keys), self.needs_elapsed, elapsed)


@dataclass(frozen=True)
class TierConfig:
    name: str
    tiers: tuple[Tier, ...]
    min_obs: int = DEFAULTS.tier_min_obs
    agg: str = "median"
    correction: str = ""  # "linear": plus the schedule deviation; "per_route": the last resort where it was better in training


def _tiers(*steps: tuple[str, ...], elapsed: int) -> tuple[Tier, ...]:
    letters = "ABCDEFGH"
    return tuple(Tier(letters[i], STOPS + extra, i < elapsed) for i, extra in enumerate(steps))


E, S, P, O3, O4, DAY = "elapsed_decile", "segment_decile", "is_stopped", "on_time_3bin", "on_time_4bin", "day_type"

E15, E20, CUSTOM = "elapsed_15", "elapsed_20", "elapsed_custom"

# fixed values: the six-tier baseline and the sweep's configurations
SIX_TIERS = _tiers((E, S, P, O4), (E, S, P), (E, S), (E,), (S,), (), elapsed=4)
SIX_TIERS_3BIN = _tiers((E, S, P, O3), (E, S, P), (E, S), (E,), (S,), (), elapsed=4)
BASELINE = TierConfig("4D-ot4", SIX_TIERS)
SWEEP = (
    TierConfig("control", _tiers((E, S, DAY), (E, DAY), (S, DAY), (DAY,), elapsed=2), 5),
    TierConfig("no-daytype", _tiers((E, S), (E,), (S,), (), elapsed=2), 5),
    TierConfig("+stopped", _tiers((E, S, P, DAY), (E, S, DAY), (E, DAY), (S, DAY), (DAY,), elapsed=3), 5),
    TierConfig("+stopped-nodt", _tiers((E, S, P), (E, S), (E,), (S,), (), elapsed=3), 3),
    TierConfig("replace-seg", _tiers((E, P, DAY), (E, DAY), (P, DAY), (DAY,), elapsed=2), 5),
    TierConfig("4D-ot3", SIX_TIERS_3BIN, 3),
    BASELINE,
    TierConfig("4D-ot4-mo3", SIX_TIERS, 3),
    TierConfig("4D-mean", SIX_TIERS, 2, "mean"),
    TierConfig("4D-mo1", SIX_TIERS, 1),
    TierConfig("4D-e15", tuple(t.by(E15) for t in SIX_TIERS)),
    TierConfig("4D-e20", tuple(t.by(E20) for t in SIX_TIERS)),
    TierConfig("4D-custom", tuple(t.by(CUSTOM) for t in SIX_TIERS)),
    TierConfig("4D+linear-ot", SIX_TIERS, correction="linear"),
    TierConfig("4D+per-route", SIX_TIERS, correction="per_route"),
)
CUSTOM_ELAPSED_EDGES = (0, 10, 20, 30, 45, 60, 80, 100, 120, 160, 220, 300, 400, float("inf"))
SCORE_BUCKETS = (("0-1min", 0, 60), ("1-2min", 60, 120), ("2-5min", 120, 300), ("5-10min", 300, 600), ("10-20min", 600, 1200), ("20min+", 1200, 1e9))


def elapsed_seconds(ts: str = "ts_ms", last: str = "last_stop_time_ms") -> Column:
    return (F.col(ts) - F.col(last)) / F.lit(1000.0)


def quantile_bins_fit(df: DataFrame, value: Column, n_bins: int = 10, low: float = 0.0) -> Column:
    """Bin edges as an array column expression: quantiles, duplicates dropped, ends opened to [low, inf)."""
    return quantile_bins_fit_all(df, value, [n_bins], low)[n_bins]


def quantile_bins_fit_all(df: DataFrame, value: Column, numbers: Sequence[int], low: float = 0.0) -> dict[int, Column]:
    """The edges for several numbers of bins, from one selection of all their quantiles."""
    probs = {f"q{n}_{i}": i / n for n in numbers for i in range(n + 1)}
    row = materialize(grouped_quantiles(df.where(value >= low), [], value, probs))
    out = {}
    for n in numbers:
        edges = F.array_distinct(F.array(*[F.col(f"q{n}_{i}") for i in range(n + 1)]))
        opened = F.concat(F.array(F.lit(low)), F.slice(edges, 2, F.size(edges) - 2), F.array(F.lit(float("inf"))))
        out[n] = row.select(opened.alias("edges")).scalar()
    return out


def quantile_bins_apply(df: DataFrame, value: Column, edges: Column, output: str) -> DataFrame:
    """Right-closed bin per row. The edges become a column first: lambdas may not hold subqueries."""
    return df.withColumn("_edges", edges).withColumn(output, bin_index(value, F.col("_edges"))).drop("_edges")


def with_tier_bins(df: DataFrame, elapsed_edges: Column) -> DataFrame:
    """The binned dimensions the tiers are keyed by."""
    return quantile_bins_apply(df, elapsed_seconds(), elapsed_edges, E).select(
        "*",
        segment_decile("progress", "target_stop_progress", "last_stop_progress").alias(S),
        is_stopped("speed").alias(P),
        on_time_bin("last_stop_on_time").alias(O4),
        on_time_bin3("last_stop_on_time").alias(O3),
    )


def _expanded(train: DataFrame, tiers: Sequence[Tier], value: str, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    names = list(dict.fromkeys(k for t in tiers for k in t.keys))
    versions = []
    for i, tier in enumerate(tiers):
        fields = [F.lit(i).alias("_tier")]
        fields += [(F.col(k) if k in tier.keys else F.lit(None).cast(train.schema[k].dataType)).alias(k) for k in names]
        allowed = F.col(tier.elapsed) >= 0 if tier.needs_elapsed else F.lit(True)
        versions.append(F.when(allowed, F.struct(*fields)))
    exploded = train.select(*keep, F.col(value).alias("_value"), F.explode(F.array_compact(F.array(*versions))).alias("_v"))
    return exploded.select(*keep, "_value", "_v.*"), ["_tier", *names]


def tier_fit(train: DataFrame, config: TierConfig, value: str = "label_s") -> DataFrame:
    """All tiers' cells in one table: tier number, key columns (NULL where unused), value."""
    rows, keys = _expanded(train, config.tiers, value)
    if config.agg == "mean":
        cells = rows.groupBy(*keys).agg(F.avg("_value").alias("value"), F.count("_value").alias("n"))
    else:
        cells = grouped_quantiles(rows, keys, "_value", {"value": 0.5}, "n")
    return cells.where(F.col("n") >= config.min_obs)


def tier_days(train: DataFrame, config: TierConfig, day: str, value: str = "label_s") -> DataFrame:
    """Daily summaries of all tiers' cells, which :func:`tier_fit_days` merges."""
    rows, keys = _expanded(train, config.tiers, value, [day])
    return daily(rows, keys, "_value", day)


def tier_fit_days(summary: DataFrame, config: TierConfig) -> DataFrame:
    """What :func:`tier_fit` finds, from daily summaries: a refit reads one new day of rows."""
    keys = ["_tier", *dict.fromkeys(k for t in config.tiers for k in t.keys)]
    if config.agg == "mean":
        cells = merged_moments(summary, keys).select(*keys, F.col("mean").alias("value"), "n")
    else:
        cells = merged_quantiles(summary, keys, {"value": 0.5})
    return cells.where(F.col("n") >= config.min_obs)


def with_hits(df: DataFrame, cells: DataFrame, tiers: Sequence[Tier], values: Sequence[str], name: str = "_dict") -> tuple[DataFrame, list[Column]]:
    """``df`` joined with all tiers' cells at once, and for each tier its values for a row (a struct, NULL if it has none).

    Tiers that share no key column are joined one by one.
    """
    common = [k for k in tiers[0].keys if all(k in t.keys for t in tiers)]
    if not common:
        for i, tier in enumerate(tiers):
            df = df.join(cells.where(F.col("_tier") == i).select(*tier.keys, F.struct(*values).alias(f"{name}{i}")), list(tier.keys), "left")
        return df, [F.col(f"{name}{i}") for i in range(len(tiers))]
    extra = [[k for k in t.keys if k not in common] for t in tiers]
    joined = df.join(folded(cells, common, extra, values, output=name), common, "left")
    return joined, [found(name, i, keys) for i, keys in enumerate(extra)]


def tier_apply(df: DataFrame, cells: DataFrame, config: TierConfig, last_resort: str | None = None, output: str = "baseline",
               values: Sequence[str] = ("value",)) -> DataFrame:
    """First tier that knows the row answers; the tier's name is reported, ``last`` for the last resort."""
    joined, hits = with_hits(df, cells, config.tiers, values)
    name = reduce(
        lambda w, i: w.when(hits[i].isNotNull(), config.tiers[i].name), range(1, len(hits)),
        F.when(hits[0].isNotNull(), config.tiers[0].name),
    )
    if last_resort:
        name = name.when(F.col(last_resort).isNotNull(), "last")
    columns = []
    for v in values:
        first = F.coalesce(*[h[v] for h in hits], *([F.col(last_resort)] if last_resort else []))
        columns.append(first.alias(output if len(values) == 1 else v))
    return joined.select(*df.columns, *columns, name.otherwise("none").alias("tier"))


def tier_quantiles_fit(train: DataFrame, config: TierConfig, probs: dict[str, float], value: str = "label_s") -> DataFrame:
    """Like :func:`tier_fit` with several quantiles per cell."""
    rows, keys = _expanded(train, config.tiers, value)
    return grouped_quantiles(rows, keys, "_value", probs, "n").where(F.col("n") >= config.min_obs)


def tier_coverage(df: DataFrame) -> DataFrame:
    """Rows and share answered by each tier."""
    counts = df.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("pct", F.try_divide(F.col("n"), total) * 100)


def residual(df: DataFrame, label: str = "label_s", baseline: str = "baseline") -> DataFrame:
    return df.withColumn("residual", F.col(label) - F.col(baseline))


def linear_correction(df: DataFrame, baseline: str = "baseline", delay: str = "last_stop_on_time", factor: float = 1.0) -> DataFrame:
    """Baseline plus the last stop's schedule deviation; NULL where that is unknown."""
    return df.withColumn("corrected", F.col(baseline) + F.lit(factor) * F.col(delay))


def per_route_best(train: DataFrame, test: DataFrame, methods: Sequence[str], label: str = "label_s") -> DataFrame:
    """Per route the method with the lowest training error; unseen routes use the first method."""
    errors = train.groupBy("route_id").agg(*[F.avg(F.abs(F.col(label) - F.col(m))).alias(m) for m in methods])
    ranked = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("e"), F.lit(i).alias("i"))) for i, m in enumerate(methods)])))
    best = errors.select("route_id", F.get(ranked, F.lit(0))["i"].alias("_best"))
    joined = test.join(best, "route_id", "left")
    chosen = F.get(F.array(*[F.col(m) for m in methods]), F.coalesce("_best", F.lit(0)))
    name = F.get(F.array(*[F.lit(m) for m in methods]), F.coalesce("_best", F.lit(0)))
    return joined.select(*test.columns, chosen.alias("best_value"), name.alias("best_method"))


def with_sweep_bins(df: DataFrame, edges: dict[int, Column]) -> DataFrame:
    """All dimensions the sweep's tiers are keyed by; ``edges`` for 10, 15 and 20 bins of the elapsed time."""
    out = with_tier_bins(df, edges[10])
    for name, cut in ((E15, edges[15]), (E20, edges[20]), (CUSTOM, F.array(*[F.lit(float(e)) for e in CUSTOM_ELAPSED_EDGES]))):
        out = quantile_bins_apply(out, elapsed_seconds(), cut, name)
    return out


def sweep_scores(rows: DataFrame, configs: Sequence[TierConfig], label: str, last_resort: str, split: str = "split", deviation: str = "last_stop_on_time",
                 store: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """(config, split, label, estimate, tier, stops_away) of each row outside ``split`` = train, for each configuration.

    Configurations share most of their tiers: each distinct tier is fitted once (with its count, whatever the threshold), and all
    tiers of one aggregate are one join.
    """
    joined, hit = rows, {}
    train = rows.where(F.col(split) == "train")
    for agg in dict.fromkeys(c.agg for c in configs):
        distinct = list(dict.fromkeys(Tier("", t.keys, t.needs_elapsed, t.elapsed) for c in configs if c.agg == agg for t in c.tiers))
        cells = store(tier_fit(train, TierConfig("every", tuple(distinct), 1, agg), label))
        joined, hits = with_hits(joined, cells, distinct, ["value", "n"], f"_{agg}")
        joined = joined.withColumns({f"_{agg}{i}": h for i, h in enumerate(hits)}).drop(f"_{agg}")
        hit |= {(agg, t.keys, t.needs_elapsed): F.col(f"_{agg}{i}") for i, t in enumerate(distinct)}
    known, tier = [], []
    for config in configs:
        cells = [hit[config.agg, t.keys, t.needs_elapsed] for t in config.tiers]
        values = [F.when(h["n"] >= config.min_obs, h["value"]) for h in cells]
        known.append(F.coalesce(*values, F.col(last_resort)))
        name = F.when(F.col(last_resort).isNotNull(), "last")
        for t, v in zip(reversed(config.tiers), reversed(values), strict=True):
            name = F.when(v.isNotNull(), t.name).otherwise(name)
        tier.append(F.lit(None).cast("string") if config.correction else name)
    slim = store(joined.select("route_id", split, F.col(label).alias("label"), F.col(last_resort).alias("resort"), F.col(deviation).alias("deviation"), "stops_away",
                               *[e.alias(f"e{i}") for i, e in enumerate(known)], *[n.alias(f"t{i}") for i, n in enumerate(tier)]))
    away = lambda c: F.avg(F.abs(F.col("label") - F.col(c)))
    base = {i: c for i, c in enumerate(configs) if c.correction == "per_route"}
    better = slim.where(F.col(split) == "train").groupBy(F.col("route_id").alias("_route")).agg(*[(away("resort") < F.coalesce(away(f"e{i}"), F.lit(float("inf")))).alias(f"better{i}") for i in base] or [F.lit(None).alias("_none")])
    scored = slim.where(F.col(split) != "train").join(better, F.col("route_id") == F.col("_route"), "left")

    def corrected(i: int, c: TierConfig) -> Column:
        if c.correction == "linear":
            return F.col(f"e{i}") + F.col("deviation")
        return F.when(F.coalesce(F.col(f"better{i}"), F.lit(False)), F.col("resort")).otherwise(F.col(f"e{i}")) if c.correction else F.col(f"e{i}")

    each = F.array(*[F.struct(F.lit(c.name).alias("config"), corrected(i, c).cast("double").alias("estimate"), F.col(f"t{i}").alias("tier")) for i, c in enumerate(configs)])
    return scored.select(F.col(split).alias("split"), "label", "stops_away", F.explode(each).alias("_s")).select("_s.config", "split", "label", "_s.estimate", "_s.tier", "stops_away")


def sweep_breakdown(scores: DataFrame, least: int = 10) -> DataFrame:
    """(config, split, dimension, item, mae, n_answered, n): overall, by bucket of the label, by stops away (with ``least`` answered
    rows) and by the tier that answered. One aggregation over all of them."""
    bucket = F.lit(None).cast("string")
    for name, low, high in SCORE_BUCKETS:
        bucket = F.when((F.col("label") >= low) & (F.col("label") < high), name).otherwise(bucket)
    parts = {"overall": F.lit("all"), "bucket": bucket, "stops_away": F.col("stops_away").cast("string"), "tier": F.col("tier")}
    items = F.filter(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("item")) for k, v in parts.items()]), lambda s: s["item"].isNotNull())
    tall = scores.select("config", "split", F.abs(F.col("label") - F.col("estimate")).alias("_e"), F.explode(items).alias("_i")).select("config", "split", "_i.*", "_e")
    found = tall.groupBy("config", "split", "dimension", "item").agg(F.avg("_e").alias("mae"), F.count("_e").alias("n_answered"), F.count("*").alias("n"))
    return found.where((F.col("dimension") == "overall") | (F.col("n_answered") >= F.when(F.col("dimension") == "stops_away", least).otherwise(1)))


def config_sweep(scores: DataFrame) -> DataFrame:
    """Error and coverage of every configuration on test and validation rows, and which one is best on the test rows."""
    of = lambda split, v: F.max(F.when(F.col("split") == split, v))
    share = F.try_divide(F.col("n_answered"), F.col("n")) * 100
    overall = sweep_breakdown(scores).where("dimension = 'overall'").groupBy("config").agg(
        of("test", F.col("mae")).alias("mae"), of("val", F.col("mae")).alias("val_mae"), of("test", F.col("n_answered")).alias("n_answered"), of("test", share).alias("coverage_pct"))
    # a row a configuration; equally good ones are told apart by their names
    best = F.row_number().over(Window.orderBy(F.col("mae").asc_nulls_last(), "config")) == 1
    return overall.withColumn("best", best)
