"""Lookup tables of several levels folded into one, so that facts are joined once however many levels there are.

Cells whose keys share some columns become one row for each combination of these, holding a small hash table: an array of maps, the
map of a key's hash. Its size follows the cells under that combination; a look-up reads one map of one or two entries. Spark evaluates
it in the projection above the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(level: Column, keys: Sequence[str]) -> Column:
    """Text of a level and its key columns; NULL if one of these is, as such keys match nothing."""
    return F.concat(level.cast("string"), *[F.concat(F.lit("|"), F.col(k).cast("string")) for k in keys])


def folded(cells: DataFrame, common: Sequence[str], levels: Sequence[Sequence[str]], values: Sequence[str], level: str = "_tier", output: str = "_dict") -> DataFrame:
    """One row for each ``common`` with the cells of all levels; ``levels``: the key columns of each beside ``common``.

    ``cells`` has the number of its level in ``level`` and NULL in the keys that level doesn't use. They are dealt by ``common`` once and
    joined with nothing: written cells are small as files and large as rows, so Spark would broadcast them.
    """
    text = F.lit(None).cast("string")
    for i, keys in enumerate(levels):
        text = F.when(F.col(level) == i, _key(F.lit(i), keys)).otherwise(text)
    known = F.col("_key").isNotNull()
    for c in common:
        known = known & F.col(c).isNotNull()
    keyed = cells.select(*common, text.alias("_key"), F.struct(*values).alias("_value")).where(known)
    whole = Window.partitionBy(*common)
    numbered = keyed.select(
        "*", F.pmod(F.xxhash64("_key"), F.count(F.lit(1)).over(whole)).cast("int").alias("_at"), (F.row_number().over(whole.orderBy("_key")) - 1).alias("_nth"))
    # a combination has as many slots as cells: its n-th cell also stands for the n-th slot, so that empty ones are there too
    entry = F.struct("_key", "_value")
    nothing = F.when(F.lit(False), entry)
    placed = numbered.select(*common, F.inline(F.array(F.struct("_at", entry.alias("_entry")), F.struct(F.col("_nth").alias("_at"), nothing.alias("_entry")))))
    slots = placed.groupBy(*common, "_at").agg(F.collect_list("_entry").alias("_entries"))
    return slots.groupBy(*common).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_entries"))), lambda s: F.map_from_entries(s["_entries"])).alias(output))


def found(table: str, level: int, keys: Sequence[str]) -> Column:
    """The values a level holds for the row's keys, as a struct; NULL if it has no such cell."""
    key = _key(F.lit(level), keys)
    return F.try_element_at(F.get(table, F.pmod(F.xxhash64(key), F.size(table)).cast("int")), key)
