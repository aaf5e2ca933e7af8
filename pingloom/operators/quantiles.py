"""Exact quantiles per group without holding a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the values are written once and counted in bins
(pre-aggregated before the shuffle), first those of a fixed rising function, then, inside each bin that holds a wanted rank, equal
parts of the bin's actual range, as often as it takes until such a bin holds few rows or a single value. Only the rows of these last
bins are ordered, with equal values merged into counts. So it doesn't matter how the values lie: a day of epoch milliseconds is one
bin of the first kind and thousands of the second.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.plans.stages import materialize

BINS_PER_STEP = 64
PARTS = 4_096  # of a bin's range, a round
FEW = 100_000  # rows of a bin that one task may order
SHORT = 50_000  # bins that may be broadcast, a few megabytes
MOST_ROUNDS = 8  # doubles closer than this many cuts have no values in between


def first_bin(value: Column) -> Column:
    """Rising step function: fine near zero, about 1.6 % of the value further out, for any domain."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(BINS_PER_STEP)).cast("long")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_k_{n}"]) for n in names])


def _edges(p: float) -> tuple[str, str]:
    """Zero-based ranks the quantile lies between, as SQL over the group's count."""
    return f"floor({p!r}D * (_n - 1))", f"ceil({p!r}D * (_n - 1))"


def _share() -> Column:
    """Where ``_x`` lies between ``_low`` and ``_high``, from 0 to 1: by its logarithm where these differ by scales."""
    x, low, high = F.col("_x"), F.col("_low"), F.col("_high")
    up, down = (F.ln(x) - F.ln(low)) / (F.ln(high) - F.ln(low)), (F.ln(-low) - F.ln(-x)) / (F.ln(-low) - F.ln(-high))
    return F.when((low > 0) & (high / 2 > low), up).when((high < 0) & (low / 2 < high), down).otherwise((x - low) / (high - low))


def wanted_bins(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], few: int = FEW) -> DataFrame:
    """The bins that hold the wanted ranks: (keys, _bin, _low, _high, _c, _before, _n), from ``rows``: (keys, _x, _w, _bin), written.

    ``_low`` and ``_high`` are the bin's smallest and largest value, ``_before`` the number of the group's values below it. Bins have
    at most ``few`` rows unless all are equal.
    """
    wanted = " OR ".join(f"({rank} BETWEEN _before AND _before + _c - 1)" for p in probs for rank in _edges(float(p)))
    stats = [F.sum("_w").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]
    group = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
    counted = rows.groupBy(*keys, "_bin").agg(*stats)
    bins = counted.withColumn("_n", F.sum("_c").over(group)).withColumn("_before", F.sum("_c").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    fields = [*keys, "_bin", "_low", "_high", "_c", "_before", "_n"]
    bins = materialize(bins.where(wanted).select(*fields))
    big = (F.col("_c") > few) & (F.col("_low") < F.col("_high"))
    done = bins.where(~big)
    for _ in range(MOST_ROUNDS):
        if not bins.where(big).limit(1).count():
            break
        open_ = bins.where(big)
        rows = materialize(within(rows, open_, keys).select(*keys, "_x", "_w", "_bin", "_low", "_high", "_before", "_n"))
        part = F.least(F.floor(_share() * PARTS), F.lit(PARTS - 1))
        place = [*keys, "_bin", F.col("_before").alias("_from"), "_n", part.alias("_part")]
        inside = Window.partitionBy(*keys, "_bin", "_from").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        finer = rows.groupBy(*place).agg(*stats).withColumn("_before", F.col("_from") + F.sum("_c").over(inside) - F.col("_c"))
        bins = materialize(finer.where(wanted).select(*fields))
        done = done.unionByName(bins.where(~big))
    return done.unionByName(bins.where(big))


def within(rows: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that lie in one of ``bins``, written, with that bin's columns; bins don't overlap.

    Rows are never broadcast: Spark goes by the bytes of files, a tenth of what the driver would hold, and rows of a few values take
    fewer of them than the bins. So the bins are, if there are few, and else both sides are dealt.
    """
    short = bins.limit(SHORT + 1).count() <= SHORT
    own = [*keys, "_bin"]
    named = bins.select(*[F.col(k).alias(f"_k_{k}") for k in own], "_low", "_high", "_c", "_before", "_n")
    plain = rows.select(*own, "_x", "_w")
    joined = plain.join(named.hint("broadcast" if short else "merge"), _same(plain, named, own) & F.col("_x").between(F.col("_low"), F.col("_high")))
    return joined.select(*own, "_x", "_w", "_low", "_high", "_c", "_before", "_n")


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float], count_name: str | None = None, few: int = FEW,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles (new name -> probability) and the count; missing values don't count.

    ``weight``: a column that says how often a row's value occurs (a whole number).
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, x.cast("double").alias("_x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rows = materialize(rows).withColumn("_bin", first_bin(F.col("_x")))
    bins = wanted_bins(rows, keys, list(probs.values()), few)
    merged = within(rows, bins, keys).groupBy(*keys, "_bin", "_before", "_n", "_x").agg(F.sum("_w").alias("_c"))
    inside = Window.partitionBy(*keys, "_bin", "_before").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("_start", F.sum("_c").over(inside) - F.col("_c") + F.col("_before"))
    picks = [
        F.expr(f"max(CASE WHEN {rank} BETWEEN _start AND _start + _c - 1 THEN _x END) AS `_{side}_{name}`")
        for name, p in probs.items() for side, rank in zip(("lo", "hi"), _edges(float(p)), strict=True)
    ]
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    outputs = [
        F.expr(f"`_lo_{n}` + (`_hi_{n}` - `_lo_{n}`) * ({float(p)!r}D * (_n - 1) - {_edges(float(p))[0]}) AS `{n}`") for n, p in probs.items()
    ]
    if count_name:
        outputs.append(F.col("_n").alias(count_name))
    return found.select(*keys, *outputs)
