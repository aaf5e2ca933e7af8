"""Places in an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingloom.plans.stages import materialize


def same(left: Sequence[str], right: Sequence[str]):
    """Equality of columns, nulls equal to each other."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def ranked(rows: DataFrame, order: Sequence[str], within: Sequence[str] = (), rank: str = "rank", total: str = "total") -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` among the rows of equal ``within``, and the number of those; nulls first.

    One sort by ranges of (within, order), written; a row per (range, group) then tells each range where it begins. So a group may
    span any number of tasks. Rows should be written before, as ranges are chosen from a sample; rows equal in all columns named share
    a task, so where many may be equal the last of ``order`` is a row number.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*within, *order)]
    sorted_ = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    runs = sorted_.groupBy(*within, F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    group = Window.partitionBy(*within)
    before = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"_g{k}" for k in range(len(within))]
    begin = materialize(runs.select(*[F.col(c).alias(n) for c, n in zip(within, names, strict=True)], F.col("_range").alias("_part"), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_n").over(group).alias("_all")))
    met = sorted_.withColumn("_range", F.shiftright("_at", 33)).join(begin, same([*within, "_range"], [*names, "_part"]))
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(rank), F.col("_all").alias(total))
