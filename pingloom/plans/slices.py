"""Windows that stay parallel when one key holds a large share of all rows.

A plain ``PARTITION BY vehicle`` sends a whole vehicle to one task. Here a key is cut into time
slices, so the unit of work is (key, slice):

* a window with a bounded reach copies the few rows near a slice border into the neighbour
  slice (``with_halo``): one shuffle, no second pass;
* an unbounded look-back (previous row, last known value, running total) is computed inside the
  slice and completed from one summary row per slice (``lag_across``, ``fill_across``,
  ``running_total``): the summaries are pre-aggregated before they are shuffled.

Keys must not be NULL (ingest drops pings without a vehicle): plain equality lets the join reuse
the window's partitioning. The input is read twice, so write expensive inputs first. Summaries of
slices are merged, never broadcast: where a key has few rows a slice there are as many of them as
rows, and Spark goes by the bytes of the input's files, a tenth of what the driver would hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingloom.config import DEFAULTS
from pingloom.functions.times import floor_div

SLICE = "_slice"


def with_slice(df: DataFrame, ts: str, slice_ms: int = DEFAULTS.slice_ms) -> DataFrame:
    return df.withColumn(SLICE, floor_div(ts, slice_ms))


def with_halo(
    df: DataFrame, ts: str, slice_ms: int, before_ms: int = 0, after_ms: int = 0
) -> DataFrame:
    """Copy each row into every slice whose rows look back ``before_ms`` or ahead ``after_ms`` at it.

    ``_home`` marks the one copy that is the row itself; filter on it after the window.
    """
    home = floor_div(ts, slice_ms)
    first = floor_div(F.col(ts) - F.lit(after_ms), slice_ms)
    last = floor_div(F.col(ts) + F.lit(before_ms), slice_ms)
    # a row without a time has no slice, but it stays
    return df.withColumn(SLICE, F.explode_outer(F.sequence(first, last))).withColumn("_home", F.col(SLICE).eqNullSafe(home))


def reach_slice(reach_ms: int, slice_ms: int = DEFAULTS.slice_ms) -> int:
    """Slices no shorter than the reach, so a row has at most two copies."""
    return max(reach_ms, slice_ms)


def bounded_lag(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], columns: dict[str, str], reach_ms: int,
    slice_ms: int = DEFAULTS.slice_ms,
) -> DataFrame:
    """Previous row's ``columns`` (new name -> source) where it lies at most ``reach_ms`` back, else NULL."""
    size = reach_slice(reach_ms, slice_ms)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    copies = with_halo(df, ts, size, before_ms=reach_ms)
    lagged = copies.select(
        "*", F.lag(ts).over(w).alias("_seen"), *[F.lag(src).over(w).alias(name) for name, src in columns.items()]
    ).where("_home")
    near = F.col(ts) - F.col("_seen") <= reach_ms
    return lagged.select(*df.columns, *[F.when(near, F.col(name)).alias(name) for name in columns])


def lag_across(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], columns: dict[str, str],
    slice_ms: int = DEFAULTS.slice_ms,
) -> DataFrame:
    """Previous row's ``columns`` (new name -> source), however far back it lies."""
    rows = with_slice(df, ts, slice_ms)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    tail = rows.groupBy(*keys, SLICE).agg(
        F.max_by(F.struct(*[F.col(s).alias(n) for n, s in columns.items()]), F.struct(*order)).alias("_tail")
    )
    carried = tail.select(*keys, SLICE, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_carry"))
    local = rows.select(
        "*", F.row_number().over(w).alias("_at"), *[F.lag(s).over(w).alias(f"_p_{n}") for n, s in columns.items()]
    )
    joined = local.join(carried.hint("merge"), [*keys, SLICE], "left")
    return joined.select(
        *df.columns,
        *[F.when(F.col("_at") == 1, F.col(f"_carry.{n}")).otherwise(F.col(f"_p_{n}")).alias(n) for n in columns],
    )


def fill_across(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], values: dict[str, Column],
    slice_ms: int = DEFAULTS.slice_ms,
) -> DataFrame:
    """Last non-NULL value up to and including the row, for each named expression."""
    rows = with_slice(df, ts, slice_ms).select("*", *[v.alias(n) for n, v in values.items()])
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    latest = rows.groupBy(*keys, SLICE).agg(
        *[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.struct(*order))).alias(f"_tail_{n}") for n in values]
    )
    back = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(
        *keys, SLICE, *[F.last(f"_tail_{n}", ignorenulls=True).over(back).alias(f"_carry_{n}") for n in values]
    )
    local = rows.select(
        *df.columns, SLICE, *[F.last(n, ignorenulls=True).over(w).alias(f"_here_{n}") for n in values]
    )
    joined = local.join(carried.hint("merge"), [*keys, SLICE], "left")
    return joined.select(*df.columns, *[F.coalesce(f"_here_{n}", f"_carry_{n}").alias(n) for n in values])


def running_total(
    df: DataFrame, keys: Sequence[str], part: Column, order: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums; ``part`` must not decrease along ``order`` within a key."""
    rows = df.select("*", part.alias(SLICE), *[v.alias(f"_v_{n}") for n, v in values.items()])
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    back = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, SLICE, *[F.sum(f"_t_{n}").over(back).alias(f"_c_{n}") for n in values])
    joined = rows.join(carried, [*keys, SLICE], "left")
    return joined.select(
        *df.columns,
        *[(F.sum(f"_v_{n}").over(w) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in values],
    )


def in_ranges(df: DataFrame, order: Sequence[str], name: str = SLICE, rows: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``order`` of about equal numbers of rows, however its values lie, and written; the range in ``name``.

    For :func:`running_total`, whose ``part`` it is. Ranges are chosen from a sample, so write expensive inputs first. ``rows``: about
    how many a range has, where one task holds them all; else Spark puts small ranges together by their compressed bytes.
    """
    from pingloom.plans.stages import materialize

    number = [max(1, -(-df.count() // rows))] if rows else []
    return materialize(df.repartitionByRange(*number, *order).withColumn(name, F.spark_partition_id()))


def rank_in_time(df: DataFrame, ts: str, order: Sequence[str], slice_ms: int = 60_000) -> DataFrame:
    """Exact 1-based position of every row in time order: a task sorts a minute of the whole fleet."""
    return running_total(df, [], floor_div(ts, slice_ms), order, {"rank": F.lit(1)})
