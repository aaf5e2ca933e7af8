"""Cells from daily summaries, so that a refit reads one new day and not the history.

A summary has a row a (day, cell): the number of values, their mean, the sum of their squared distances from it, and the values
themselves with their counts, rising. All of it merges without loss: cells over any set of days equal those from all rows of these
days, quantiles included. A row is bounded by what a cell sees in a day. Days are partitions of a table, replaced one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingloom.operators.quantiles import grouped_quantiles


def daily(rows: DataFrame, keys: Sequence[str], value: str, day: str) -> DataFrame:
    """(``day``, ``keys``, n, mean, m2, values: array of (x, c)); missing values don't count. Equal values merge before the shuffle."""
    x = F.col(value).cast("double")
    known = rows.where(x.isNotNull() & ~F.isnan(x)).select(day, *keys, x.alias("x"))
    counted = known.groupBy(day, *keys, "x").agg(F.count("*").alias("c"))
    total = F.sum(F.col("x") * F.col("c"))
    folded = counted.groupBy(day, *keys).agg(F.sum("c").alias("n"), (total / F.sum("c")).alias("mean"), F.array_sort(F.collect_list(F.struct("x", "c"))).alias("values"))
    away = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + (v["x"] - F.col("mean")) * (v["x"] - F.col("mean")) * v["c"])
    return folded.select(day, *keys, "n", "mean", away.alias("m2"), "values")


def write_days(summary: DataFrame, folder: str, day: str) -> None:
    """Put days into the table at ``folder``; a day that is there is replaced, others stay as they are."""
    summary.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_days(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def merged_quantiles(summary: DataFrame, keys: Sequence[str], probs: dict[str, float], count_name: str = "n") -> DataFrame:
    """Quantiles of each cell over all days of ``summary``, and the number of values."""
    values = summary.select(*keys, F.explode("values").alias("_v")).select(*keys, "_v.x", "_v.c")
    return grouped_quantiles(values, keys, "x", probs, count_name, weight="c")


def merged_moments(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number, sum, mean and sample deviation of each cell over all days of ``summary``; the deviation of one value is NULL.

    The days' squared distances are moved to the common mean, so large values with small differences keep their deviation.
    """
    total = F.sum(F.col("n") * F.col("mean"))
    parts = F.collect_list(F.struct("n", "mean", "m2"))  # a day each
    merged = summary.groupBy(*keys).agg(F.sum("n").alias("_n"), (total / F.sum("n")).alias("_mean"), parts.alias("_parts"))
    away = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["m2"] + (p["mean"] - F.col("_mean")) * (p["mean"] - F.col("_mean")) * p["n"])
    spread = F.when(F.col("_n") > 1, F.sqrt(away / (F.col("_n") - 1)))
    return merged.select(*keys, F.col("_n").alias("n"), (F.col("_mean") * F.col("_n")).alias("total"), F.col("_mean").alias("mean"), spread.alias("std"))
