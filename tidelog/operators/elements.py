"""Replaying unfrozen collections: every element is a cell of its own.

Elements are folded by maximum like scalar columns, each with its own write time, and an overwrite is a tombstone just
before its elements. Removing and adding in one change both take effect, the addition last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.collection import as_list
from tidelog.operators.skew import salted_left


def element_cells(changes: DataFrame, key: Sequence[str], column: str, kind: str, more: Sequence[str] = (), text: bool = True) -> DataFrame:
    """(key, elem, us, *more, gone, value): the element cells that each change writes; kind is set, map or list.

    ``changes`` has ``us``, ``more``, ``column`` (array for a set, else map) and ``cdc$deleted_elements_<column>``. Values are
    text, unless ``text`` is false; of a set they're the elements.
    """
    added, removed = F.col(f"`{column}`"), F.col(f"`cdc$deleted_elements_{column}`")
    of = changes.schema[column].dataType
    kept_as = T.StringType() if text else of.elementType if kind == "set" else of.valueType
    entries = (
        F.transform(added, lambda x: F.struct(x.alias("elem"), F.lit(0).alias("gone"), x.cast(kept_as).alias("value")))
        if kind == "set"
        else F.transform(F.map_entries(added), lambda e: F.struct(e["key"].alias("elem"), F.lit(0).alias("gone"), e["value"].cast(kept_as).alias("value")))
    )
    written = added if kind == "set" else F.map_keys(added)
    kept = F.array_except(as_list(removed), as_list(written))
    gone = F.transform(kept, lambda x: F.struct(x.alias("elem"), F.lit(1).alias("gone"), F.lit(None).cast(kept_as).alias("value")))
    cells = F.concat(F.coalesce(entries, F.array()), gone)
    return changes.where("us is not null").select(*key, "us", *more, F.explode(cells).alias("c")).select(*key, "us", *more, "c.elem", "c.gone", "c.value")


def current_elements(changes: DataFrame, key: Sequence[str], column: str, kind: str) -> DataFrame:
    """(key, elem, value): the elements that live after all ``changes``, in any order and with repeats.

    An overwrite (``cdc$deleted_<column>``) deletes every element written before it.
    """
    cells = element_cells(changes, key, column, kind).groupBy(*key, "elem").agg(F.max(F.struct("us", "gone", "value")).alias("w"))
    cleared = changes.where(F.coalesce(F.col(f"`cdc$deleted_{column}`"), F.lit(False))).groupBy(*key).agg((F.max("us") - 1).alias("cleared_us"))
    live = salted_left(cells, cleared, key, ["elem"]).where((F.col("w.gone") == 0) & (F.col("cleared_us").isNull() | (F.col("w.us") > F.col("cleared_us"))))
    return live.select(*key, "elem", F.col("w.value").alias("value"))
