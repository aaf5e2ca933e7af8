"""Registry of queries: name, Spark builder, SQL text."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingloom.plans.relabel import Frames, oracle

MODULES = ("sources", "filters", "scalars", "names", "joins", "geo", "windows", "events", "history", "tiers", "timetable", "evaluation", "quality", "live", "model")


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Frames], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Frames], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, build, oracle(sql) if sql else None)
        return build

    return register


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"pingloom.catalog.{module}")
    return ENTRIES


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Doubles rounded for comparison between engines; adding zero turns -0.0 into 0.0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = F.round(c, per_column.get(f.name, digits)) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def near(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)
