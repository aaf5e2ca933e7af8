"""Error metrics, overall and sliced, in one aggregation where they allow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.operators.quantiles import grouped_quantiles


def with_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    err = F.col(predicted) - F.col(actual)
    return df.withColumn("err", err).withColumn("abs_err", F.abs(err))


def reconstruct_eta(df: DataFrame, baseline: str = "baseline", pred_residual: str = "pred_residual", schedule: str | None = None) -> DataFrame:
    """Prediction from baseline and predicted residual; the naive one is the schedule, never negative."""
    out = df.withColumn("predicted", F.col(baseline) + F.col(pred_residual))
    return out.withColumn("naive", F.greatest(F.col(schedule), F.lit(0.0))) if schedule else out


def error_columns(actual: str = "actual") -> list[Column]:
    """MAE, RMSE, MAPE over positive actuals, spread of the absolute error, count."""
    return [
        F.avg("abs_err").alias("mae"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        (F.avg(F.when(F.col(actual) > 0, F.try_divide(F.col("abs_err"), F.col(actual)))) * 100).alias("mape"),
        F.stddev_pop("abs_err").alias("std_ae"),
        F.count(F.lit(1)).alias("n"),
    ]


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = "actual") -> DataFrame:
    """Error metrics with the exact median of the absolute error, per group or overall."""
    plain = (df.groupBy(*keys) if keys else df.groupBy()).agg(*error_columns(actual))
    median = grouped_quantiles(df, keys, "abs_err", {"median_ae": 0.5})
    if not keys:
        return plain.withColumn("median_ae", median.select("median_ae").scalar())
    return plain.join(median, list(keys))


def sliced_metrics(df: DataFrame, dims: Sequence[str], actual: str = "actual") -> DataFrame:
    """Overall and one slice per dimension in a single GROUPING SETS pass: (dimension, slice, metrics)."""
    names = F.array(F.lit("overall"), *[F.lit(d) for d in dims])
    sets = [[], *[[F.col(d)] for d in dims]]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id(*[F.col(d) for d in dims]).alias("_gid"), *error_columns(actual)
    )
    full = (1 << len(dims)) - 1
    which = F.when(F.col("_gid") == full, F.lit(0))
    value = F.when(F.col("_gid") == full, F.lit("all"))
    for i, d in enumerate(dims):
        mine = full - (1 << (len(dims) - 1 - i))
        which = which.when(F.col("_gid") == mine, F.lit(i + 1))
        value = value.when(F.col("_gid") == mine, F.col(d).cast("string"))
    metrics = [c for c in grouped.columns if c not in (*dims, "_gid")]
    return grouped.select(F.get(names, which).alias("dimension"), value.alias("slice"), *metrics)


def directional(df: DataFrame) -> DataFrame:
    """Rates, mean absolute and mean signed error of over- and underestimates; 0 where a side is empty."""
    over, under = F.col("err") > 0, F.col("err") < 0
    side = lambda cond, c: F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))
    return df.agg(
        F.avg(over.cast("int")).alias("overestimate_rate"), F.avg(under.cast("int")).alias("underestimate_rate"),
        side(over, "abs_err").alias("overestimate_mae"), side(under, "abs_err").alias("underestimate_mae"),
        side(over, "err").alias("overestimate_mean"), side(under, "err").alias("underestimate_mean"),
    )


def within_thresholds(df: DataFrame, limits: Sequence[int] = (30, 60, 90, 120, 180, 300), tails: Sequence[int] = (300, 600, 900),
                      inclusive: bool = False) -> DataFrame:
    """Share of rows below each limit (strict unless ``inclusive``) and beyond each tail."""
    inside = lambda t: (F.col("abs_err") <= t) if inclusive else (F.col("abs_err") < t)
    return df.agg(
        *[F.avg(inside(t).cast("int")).alias(f"within_{t}s") for t in limits],
        *[F.avg((F.col("abs_err") > t).cast("int")).alias(f"tail_{t}s") for t in tails],
    )


def error_percentiles(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """p50..p99 of the absolute error and p5..p95 of the signed one."""
    kinds = {"abs": ("abs_err", (50, 75, 90, 95, 99)), "err": ("err", (5, 25, 50, 75, 95))}
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).cast("double").alias("_v")) for k, (c, _) in kinds.items()])).alias("_e")
    tall = df.select(*keys, both).select(*keys, "_e.*")
    every = sorted({p for _, ps in kinds.values() for p in ps})
    q = grouped_quantiles(tall, [*keys, "_kind"], "_v", {f"p{p}": p / 100 for p in every}, "_n")
    of = lambda kind, column: F.max(F.when(F.col("_kind") == kind, F.col(column)))
    found = [of(k, f"p{p}").alias(f"{k}_p{p}") for k, (_, ps) in kinds.items() for p in ps]
    return q.groupBy(*keys).agg(*found[:5], of("abs", "_n").alias("n"), *found[5:])


def moments(df: DataFrame, column: str = "err") -> DataFrame:
    return df.agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.skewness(column).alias("skew"),
        F.kurtosis(column).alias("kurtosis"), F.min(column).alias("min_error"), F.max(column).alias("max_error"),
    )


def compare_to_baseline(df: DataFrame, actual: str = "actual", baseline: str = "baseline") -> DataFrame:
    base = F.abs(F.col(baseline) - F.col(actual))
    return df.agg(
        F.avg(base).alias("baseline_mae"), F.avg("abs_err").alias("model_mae"),
        F.avg((F.col("abs_err") < base).cast("int")).alias("model_better_rate"),
    ).select(
        "*", (F.col("baseline_mae") - F.col("model_mae")).alias("improvement_s"),
        F.coalesce(F.try_divide(F.col("baseline_mae") - F.col("model_mae"), F.col("baseline_mae")) * 100, F.lit(0.0)).alias("improvement_pct"),
    )


def win_loss(df: DataFrame, by: str, actual: str = "actual", naive: str = "baseline", low_sample: int = 200) -> DataFrame:
    """Per group: naive and model error, verdict with one percent tolerance, low-sample mark."""
    per = df.groupBy(by).agg(
        F.avg(F.abs(F.col(naive) - F.col(actual))).alias("naive_mae"), F.avg("abs_err").alias("model_mae"), F.count(F.lit(1)).alias("n")
    )
    verdict = F.when(F.col("model_mae") < F.col("naive_mae") * 0.99, "WIN").when(F.col("model_mae") > F.col("naive_mae") * 1.01, "LOSS").otherwise("TIE")
    return per.select(
        "*", F.coalesce(F.try_divide(F.col("naive_mae") - F.col("model_mae"), F.col("naive_mae")) * 100, F.lit(0.0)).alias("improvement_pct"),
        verdict.alias("verdict"), (F.col("n") < low_sample).cast("int").alias("low_sample"),
    )


def win_loss_summary(per_group: DataFrame) -> DataFrame:
    return per_group.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("WIN", "LOSS", "TIE")]
    )


def bias_flags(df: DataFrame, dim: str, threshold: float = 15.0) -> DataFrame:
    """Mean and median signed error, share of overestimates and the verdict, per slice."""
    per = df.groupBy(dim).agg(F.avg("err").alias("mean_err"), F.avg((F.col("err") > 0).cast("int")).alias("over_rate"), F.count(F.lit(1)).alias("n"))
    flag = F.when(F.col("mean_err") > threshold, "OVER").when(F.col("mean_err") < -threshold, "UNDER").otherwise("OK")
    return per.join(grouped_quantiles(df, [dim], "err", {"median_err": 0.5}), dim).withColumn("bias", flag)


def bias_flags_all(df: DataFrame, dims: Sequence[str], threshold: float = 15.0) -> DataFrame:
    """The bias of every slice of every dimension in one result: (dimension, slice, ...)."""
    named = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims]
    tall = df.select("err", F.explode(F.array(*named)).alias("_s")).select("err", "_s.*")
    per = tall.groupBy("dimension", "slice").agg(F.avg("err").alias("mean_err"), F.avg((F.col("err") > 0).cast("int")).alias("over_rate"), F.count(F.lit(1)).alias("n"))
    median = grouped_quantiles(tall, ["dimension", "slice"], "err", {"median_err": 0.5}).select(F.col("dimension").alias("_d"), F.col("slice").alias("_v"), "median_err")
    flag = F.when(F.col("mean_err") > threshold, "OVER").when(F.col("mean_err") < -threshold, "UNDER").otherwise("OK")
    return per.join(median, (F.col("dimension") == F.col("_d")) & F.col("slice").eqNullSafe(F.col("_v"))).drop("_d", "_v").withColumn("bias", flag)


def horizon_table(df: DataFrame, bucket: Column, name: str, min_n: int = 50) -> DataFrame:
    """Error and bias per bucket with enough rows."""
    return df.groupBy(bucket.alias(name)).agg(
        F.avg("abs_err").alias("mae"), F.avg("err").alias("bias"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= min_n)


def by_period(df: DataFrame, hour: str = "hour", min_n: int = 10) -> DataFrame:
    """Per hour with more than ``min_n`` rows, marked rush or off-peak."""
    rush = F.col(hour).between(7, 8) | F.col(hour).between(16, 17)
    return df.groupBy(hour).agg(
        F.avg("abs_err").alias("mae"), F.avg("err").alias("bias"), F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") > min_n).withColumn("period", F.when(rush, "rush").otherwise("off_peak"))


def period_totals(df: DataFrame, hour: str = "hour", actual: str = "actual") -> DataFrame:
    """The error metrics of the morning rush, the afternoon rush and the rest of the day."""
    period = F.when(F.col(hour).between(7, 8), "morning_rush").when(F.col(hour).between(16, 17), "afternoon_rush").otherwise("off_peak")
    return regression_metrics(df.withColumn("period", period), ["period"], actual)


def by_feature_range(df: DataFrame, feature: str, limits: Sequence[tuple[float, float]], baseline: str | None = None, actual: str = "actual") -> DataFrame:
    """Error, bias and count in half-open ranges of a feature; optionally against a baseline."""
    label = F.when(F.lit(False), F.lit(None))
    for low, high in limits:
        label = label.when((F.col(feature) >= low) & (F.col(feature) < high), F.lit(f"{low:g}-{high:g}"))
    extra = [F.avg(F.abs(F.col(baseline) - F.col(actual))).alias("baseline_mae")] if baseline else []
    out = df.groupBy(label.alias("range")).agg(F.avg("abs_err").alias("mae"), F.avg("err").alias("bias"), F.count(F.lit(1)).alias("n"), *extra)
    out = out.where("range IS NOT NULL")
    if baseline:
        out = out.withColumn("model_better", (F.col("mae") < F.col("baseline_mae")).cast("int"))
    return out


def worst_k(df: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """The ``k`` largest absolute errors (each task keeps its own k before they meet)."""
    return df.orderBy(F.desc("abs_err"), *tie).limit(k)


def quantile_eval(df: DataFrame, low: str, mid: str, high: str, actual: str) -> DataFrame:
    """Crossings before the row-wise sort repair; range and coverage after it."""
    crossing = (F.col(low) > F.col(mid)) | (F.col(mid) > F.col(high)) | (F.col(low) > F.col(high))
    ordered = F.array_sort(F.array(low, mid, high))
    fixed = df.select(F.col(actual).alias("_y"), crossing.alias("_x"), F.get(ordered, F.lit(0)).alias("_lo"), F.get(ordered, F.lit(2)).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    stats = fixed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_x").alias("n_crossing"), F.avg(span).alias("mean_range"),
        F.avg((span < 60).cast("int")).alias("narrow_rate"), F.avg((span > 300).cast("int")).alias("wide_rate"),
        F.avg(F.col("_y").between(F.col("_lo"), F.col("_hi")).cast("int")).alias("coverage"),
    )
    median = grouped_quantiles(fixed, [], span, {"m": 0.5}).select("m").scalar()
    return stats.withColumn("median_range", median)


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    e = actual - predicted
    return F.when(e >= 0, e * F.lit(q)).otherwise(e * F.lit(q - 1))


def huber(x: Column, delta: float) -> Column:
    size = F.abs(x)
    return F.when(size < delta, x * x * 0.5).otherwise((size - F.lit(0.5 * delta)) * F.lit(delta))


def loss_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", alpha: float = 5.0, delta: float = 60.0,
                 proximity_alpha: float = 3.0, proximity_s: float = 300.0) -> DataFrame:
    """Training losses as evaluation metrics."""
    y, p = F.col(actual), F.col(predicted)
    e = p - y
    over = F.greatest(e, F.lit(0.0))
    near = F.greatest(F.lit(1.0), F.least(F.lit(proximity_alpha), F.lit(1.0) + F.lit(proximity_alpha - 1) * (F.lit(1.0) - p / proximity_s)))
    weight = F.when(e > 0, F.lit(proximity_alpha) * near).otherwise(F.lit(1.0))
    le = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y)
    lover = F.greatest(le, F.lit(0.0))
    return df.agg(
        F.avg(pinball(y, p, 0.2)).alias("pinball_20"), F.avg(pinball(y, p, 0.5)).alias("pinball_50"), F.avg(pinball(y, p, 0.75)).alias("pinball_75"),
        F.avg(e * e + over * over * alpha).alias("asymmetric_squared"),
        F.avg(huber(e, delta) + huber(over, delta) * alpha).alias("asymmetric_huber"),
        F.avg(weight * e * e * 0.5).alias("proximity_weighted"),
        F.avg(le * le + lover * lover * alpha).alias("log_space"),
    )


def ordering_penalty(df: DataFrame, etas: str) -> DataFrame:
    """Mean amount by which a nearer stop's ETA exceeds the next one's, summed over neighbours."""
    steps = F.transform(F.sequence(F.lit(1), F.size(etas) - 1), lambda i: F.greatest(F.element_at(etas, i) - F.element_at(etas, i + 1), F.lit(0.0)))
    return df.agg(F.avg(F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)).alias("ordering_penalty"))


def error_histogram(df: DataFrame, value: str, low: float, high: float, step: float) -> DataFrame:
    """Counts per bin of equal width inside [low, high)."""
    bin_no = F.floor((F.col(value) - F.lit(low)) / F.lit(step)).cast("long")
    return df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def improvement_chain(rows: DataFrame) -> DataFrame:
    """Models in order with their gain over the first (naive) one; a handful of rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("step")
    first = F.first("mae").over(w)
    return rows.withColumn("vs_naive_pct", (first - F.col("mae")) / first * 100).withColumn(
        "vs_previous_pct", (F.lag("mae").over(w) - F.col("mae")) / F.lag("mae").over(w) * 100
    )
