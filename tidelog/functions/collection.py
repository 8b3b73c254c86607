"""Changes to unfrozen collections, as expressions on one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu


def set_add(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_union(as_list(old), as_list(new)))


def set_remove(old: Column, gone: Column) -> Column:
    return F.array_sort(F.array_except(as_list(old), as_list(gone)))


def map_put(old: Column, new: Column) -> Column:
    """Entries of ``new`` win; keys may repeat between the two."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def map_remove(old: Column, keys: Column) -> Column:
    return F.when(keys.isNull(), old).otherwise(F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)))


def list_set(cells: Column, new: Column) -> Column:
    """Write list cells; a list is a map from time-based uuid to value."""
    return map_put(cells, new)


def list_delete(cells: Column, keys: Column) -> Column:
    return map_remove(cells, keys)


def list_values(cells: Column) -> Column:
    """The values of list cells in order of time, then of the rest of the uuid."""
    keyed = F.transform(F.map_entries(cells), lambda e: F.struct(tu.ticks(e["key"]).alias("t"), F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda e: e["v"])


def overwrite(_old: Column, new: Column) -> Column:
    return new


def as_list(c: Column) -> Column:
    return F.coalesce(c, F.array())
