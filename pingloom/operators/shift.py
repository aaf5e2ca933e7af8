"""Distribution shift between all rows and the high-error rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingloom.operators.quantiles import grouped_quantiles
from pingloom.plans.slices import in_ranges, running_total
from pingloom.plans.stages import materialize


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, feature) with the value as a double."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(keep), list(features), "feature", "value")


def feature_stats(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, missing share, mean, population deviation, range and quantiles per feature."""
    tall = long_form(df, features, keys)
    by = [*keys, "feature"]
    plain = tall.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    ).withColumn("null_pct", F.try_divide("n_null", "n") * 100)
    q = grouped_quantiles(tall, by, "value", {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return plain.join(q, by, "left")


def value_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values (a report)."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def high_error_split(df: DataFrame, error: str = "abs_err", share: float = 0.10, tail: float = 0.02) -> DataFrame:
    """Flags rows at or above the error's (1 - share) and (1 - tail) quantiles."""
    cut = grouped_quantiles(df, [], error, {"a": 1 - share, "b": 1 - tail}).select(F.struct("a", "b").alias("c")).scalar()
    return df.withColumn("high_error", (F.col(error) >= cut["a"]).cast("int")).withColumn("tail_error", (F.col(error) >= cut["b"]).cast("int"))


def high_error_summary(flagged: DataFrame, error: str = "abs_err") -> DataFrame:
    when = lambda f: F.avg(F.when(F.col(f) == 1, F.col(error)))
    return flagged.agg(
        F.avg(error).alias("overall_mae"), when("high_error").alias("high_error_mae"), when("tail_error").alias("tail_error_mae"),
        F.sum("high_error").cast("long").alias("n_high"), F.sum("tail_error").cast("long").alias("n_tail"), F.count(F.lit(1)).alias("n"),
    )


def ks_statistic(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each feature: all rows against the flagged ones.

    Equal values merge first; the running counts go by ranges of about equal numbers of values (see ``running_total``), so no
    feature is scanned by a single task.
    """
    tall = long_form(df, features, [flag]).where("value IS NOT NULL")
    counts = materialize(tall.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_a"), F.count_if(F.col(flag) == 1).alias("_b")))
    total = counts.groupBy("feature").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    cut = in_ranges(counts, ["feature", "value"], "_range")
    running = running_total(cut, ["feature"], F.col("_range"), ["value"], {"_ca": F.col("_a"), "_cb": F.col("_b")})
    gap = F.abs(F.try_divide("_ca", "_na") - F.try_divide("_cb", "_nb"))
    return running.join(total, "feature").groupBy("feature").agg(F.max(gap).alias("ks"))


def category_shift(df: DataFrame, column: str, flag: str, eps: float = 1e-10) -> DataFrame:
    """Jensen-Shannon divergence, the chi-squared statistic and the shift score of a category: all rows against flagged ones.

    The score is five times the divergence plus a fiftieth of the gap between the missing shares in percent.
    """
    every = df.groupBy(column).agg(F.count(F.lit(1)).alias("_o"), F.count_if(F.col(flag) == 1).alias("_h"))
    known = F.col(column).isNotNull()
    totals = every.agg(
        F.sum(F.when(known, F.col("_o"))).alias("_no"), F.sum(F.when(known, F.col("_h"))).alias("_nh"), F.sum("_o").alias("_ro"), F.sum("_h").alias("_rh"))
    total = totals.select(F.struct("_no", "_nh", "_ro", "_rh").alias("t")).scalar()  # one row, not a window over all categories
    shares = every.where(known).select("_o", "_h", total["_no"].alias("_no"), total["_nh"].alias("_nh"))
    po, ph = F.try_divide("_o", "_no"), F.try_divide("_h", "_nh")
    m = (po + ph) * 0.5
    part = lambda p: p * F.ln((p + eps) / (m + eps))
    expected = F.col("_o") * F.try_divide("_nh", "_no")
    missing = F.abs(F.try_divide(total["_rh"] - total["_nh"], total["_rh"]) - F.try_divide(total["_ro"] - total["_no"], total["_ro"])) * 100
    return shares.agg(
        (F.sum(part(po)) * 0.5 + F.sum(part(ph)) * 0.5).alias("js_divergence"),
        F.sum(F.try_divide((F.col("_h") - expected) * (F.col("_h") - expected), expected)).alias("chi2"),
        F.count(F.lit(1)).alias("n_categories"),
    ).select(F.lit(column).alias("feature"), "*", (F.col("js_divergence") * 5 + F.coalesce(missing, F.lit(0.0)) * 0.02).alias("shift_score"))


def shift_ranking(df: DataFrame, features: Sequence[str], categories: Sequence[str], flag: str) -> DataFrame:
    """Numeric and categorical features in one ranking by their shift score (one row a feature)."""
    numeric = shift_table(df, features, flag).select("feature", F.lit("numeric").alias("kind"), "shift_score")
    for c in categories:
        numeric = numeric.unionByName(category_shift(df, c, flag).select("feature", F.lit("category").alias("kind"), "shift_score"))
    return numeric.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("shift_score"), "feature")))


def shift_table(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    """Numeric shift score per feature: half KS, 0.3 of the scaled mean gap, 0.2 of the missing-share gap."""
    tall = long_form(df, features, [flag])
    hit = F.col(flag) == 1
    stats = tall.groupBy("feature").agg(
        F.avg(F.col("value").isNull().cast("int")).alias("null_rate"), F.avg(F.when(hit, F.col("value").isNull().cast("int"))).alias("null_rate_high"),
        F.avg("value").alias("mean"), F.avg(F.when(hit, F.col("value"))).alias("mean_high"),
        F.stddev_pop("value").alias("std"), F.stddev_pop(F.when(hit, F.col("value"))).alias("std_high"),
    )
    gap = F.when(F.col("std") > 1e-10, F.try_divide(F.col("mean_high") - F.col("mean"), F.col("std"))).otherwise(F.lit(0.0))
    scored = stats.join(ks_statistic(df, features, flag), "feature", "left").withColumn("mean_gap", gap)
    return scored.withColumn(
        "shift_score",
        F.coalesce("ks", F.lit(0.0)) * 0.5 + F.abs("mean_gap") * 0.3 + F.abs(F.col("null_rate_high") - F.col("null_rate")) * 0.2,
    )


def shift_flags(table: DataFrame) -> DataFrame:
    """Named warnings per feature, sorted."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_sort(F.array_compact(F.array(
        flag(F.col("null_rate") > 0.5, "HIGH_NAN_OVERALL"),
        flag((F.col("null_rate_high") - F.col("null_rate")) * 100 > 5, "NAN_RATE_SPIKE"),
        flag(F.abs("mean_gap") > 0.5, "MEAN_SHIFT"),
        flag(F.col("ks") > 0.15, "STRONG_KS"),
        flag((F.col("std") == 0) | (F.col("std_high") == 0), "ZERO_VARIANCE"),
    )))
    return table.withColumn("flags", F.array_join(flags, ",")).withColumn("n_flags", F.size(flags))


def error_by_quantile_bin(df: DataFrame, feature: str, error: str = "abs_err", n: int = 20) -> DataFrame:
    """Mean error per quantile bin of a feature; bins are right-closed, equal edges merge."""
    probs = {f"q{i}": i / n for i in range(n + 1)}
    edges = grouped_quantiles(df, [], feature, probs).select(F.array_distinct(F.array(*[F.col(p) for p in probs])).alias("e")).scalar()
    x = F.col(feature)
    below = F.size(F.filter("_edges", lambda e: e < x))
    return df.where(x.isNotNull()).withColumn("_edges", edges).groupBy(F.greatest(below, F.lit(1)).cast("int").alias("bin")).agg(
        F.avg(error).alias("mean_error"), F.count(F.lit(1)).alias("n"), F.min(feature).alias("low"), F.max(feature).alias("high")
    )


def error_by_category(df: DataFrame, column: str, error: str = "abs_err") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(error).alias("mean_error"), F.count(F.lit(1)).alias("n"))
