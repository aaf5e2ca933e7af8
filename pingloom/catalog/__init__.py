"""Named queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from pingloom.catalog.registry import ENTRIES, Entry, load_all

__all__ = ["ENTRIES", "Entry", "load_all"]
