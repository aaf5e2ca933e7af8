"""Sinks: tables, compact types, patched columns, day-partitioned dumps, catalog views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.functions.times import floor_div, local_ms
from pingloom.operators.joins import lookup_left

# fixed values: small integer categories at the sink
CATEGORIES = {"route_id": "smallint", "pattern_id": "smallint", "status": "tinyint", "hour": "tinyint", "day_of_week": "tinyint"}


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = 5_000_000) -> None:
    """Parquet; a partitioned write spreads each partition value over tasks by size instead of one task per value."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def compact_types(df: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Doubles to floats, booleans to bytes, categories to small integers with missing as 0."""
    small = CATEGORIES if categories is None else categories
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.name in small:
            c = F.coalesce(c, F.lit(0)).cast(small[field.name])
        elif isinstance(field.dataType, T.DoubleType):
            c = c.cast("float")
        elif isinstance(field.dataType, T.BooleanType):
            c = c.cast("tinyint")
        out.append(c.alias(field.name))
    return df.select(*out)


def patch_columns(featured: DataFrame, rebuilt: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Columns replaced by those of a rebuilt table, by key; a row without counterpart and a doubled key fail the job."""
    fresh = rebuilt.select(*key, *columns, F.lit(1).alias("_found"))
    joined = lookup_left(featured.drop(*columns), fresh, list(key))
    guard = F.coalesce(F.col("_found"), F.raise_error(F.lit("patched table lacks a row")).cast("int"))
    return joined.where(guard == 1).select(*featured.columns)


def with_service_day(df: DataFrame, ts: str = "ts_ms", offset_h: int = -6) -> DataFrame:
    return df.withColumn("service_day", floor_div(local_ms(ts, offset_h), 86_400_000))


def split_by_service_day(df: DataFrame, path: str, ts: str = "ts_ms", offset_h: int = -6) -> DataFrame:
    """Rewrite a dump as one folder per local day; returns rows per day."""
    dated = with_service_day(df, ts, offset_h)
    write_table(dated, path, ["service_day"])
    return service_day_counts(dated)


def service_day_counts(dated: DataFrame) -> DataFrame:
    """Rows per local day and the day to resume from (the last one plus one)."""
    per = dated.groupBy("service_day").agg(F.count(F.lit(1)).alias("n"))
    last = per.agg((F.max("service_day") + 1).alias("d")).scalar()
    return per.withColumn("resume_day", last)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Temporary views for SQL users."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
