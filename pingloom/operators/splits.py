"""Temporal and random splits that can be repeated and never sort everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingloom.operators.clean import trim_zscore
from pingloom.operators.windows import dedupe_keep_first
from pingloom.plans.slices import rank_in_time


def temporal_split(df: DataFrame, day: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Split name by inclusive day range; days in no range (the gaps) are dropped."""
    name = F.when(F.lit(False), F.lit(None))
    for split, (first, last) in ranges.items():
        name = name.when(F.col(day).between(first, last), F.lit(split))
    return df.withColumn("split", name).where("split IS NOT NULL")


def split_checks(split: DataFrame, day: str) -> DataFrame:
    """Rows and day range per split, and whether each range ends at least one day before the next."""
    from pyspark.sql import Window

    per = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    w = Window.partitionBy(F.lit(0)).orderBy("first_day")  # one row per split
    gap = F.lead("first_day").over(w) - F.col("last_day") - 1
    return per.withColumn("gap_days", gap).withColumn("ok", (F.coalesce("gap_days", F.lit(1)) >= 1).cast("int"))


def ratio_time_split(df: DataFrame, ts: str, order: Sequence[str], train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Split by position in time order; the cuts truncate like integer conversion."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = F.floor(total * train)
    second = first + F.floor(total * val)
    ranked = rank_in_time(df, ts, order)
    name = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "val").otherwise("test")
    return ranked.withColumn("split", name)


def _share(keys: Sequence[str], seed: int):
    """Repeatable pseudo-random share in [0, 1) of a row key: the first 32 bits of a digest of its text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4_294_967_296.0)


def random_split(df: DataFrame, keys: Sequence[str], train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Random split by a hash of the row key: the same row always lands in the same part."""
    u = _share(keys, seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def subsample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    return df.where(_share(keys, seed) < fraction)


def ts_cv_folds(df: DataFrame, ts: str, order: Sequence[str], n_folds: int = 4) -> DataFrame:
    """Expanding-window folds: ``part`` 0 is the first training block, part k validates fold k."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(total / F.lit(n_folds + 1))
    first = total - size * n_folds
    ranked = rank_in_time(df, ts, order)
    part = F.when(F.col("rank") <= first, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("rank") - first - 1, size)) + 1)
    return ranked.withColumn("part", part.cast("int"))


def fold(df: DataFrame, k: int, label: str, z: float = 2.5) -> tuple[DataFrame, DataFrame]:
    """Training rows of fold ``k`` (trimmed on their own statistics) and its validation rows."""
    return trim_zscore(df.where(F.col("part") < k), label, z), df.where(F.col("part") == k)


def dedupe_samples(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return dedupe_keep_first(df, keys, order)


def route_partition(df: DataFrame, route: int, column: str = "route_id") -> DataFrame:
    """Marks the demand-response route, so a partitioned write keeps it apart."""
    return df.withColumn("dataset", F.when(F.col(column) == route, "demand_response").otherwise("fixed_route"))
