"""Messages delivered more than once: exactly one copy of each is kept.

Copies are ranked by arrival with every other column as tie-break, so the same copy is kept however the
input is split. A filter on a row number lets Spark cut each group to its first rows before the shuffle,
in every map task; a message of which a third of all rows are copies therefore shuffles at most one or two
rows per map task.

Nulls: null identifiers equal each other, null arrivals rank last. An empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import fresh


def _sortable(df: DataFrame, name: str) -> Column:
    """A column to sort by; kinds without an order are sorted by their JSON."""

    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    c = F.col(f"`{name}`")
    return c if ordered(df.schema[name].dataType) else F.to_json(F.struct(c))


def ranked(df: DataFrame, keys: Sequence[str], arrival: str, rank: str) -> DataFrame:
    """``df`` with column ``rank``: 1 for the first copy of each identifier, 2 for the second, and so on."""
    rest = sorted(c for c in df.columns if c not in {*keys, arrival})
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(
        F.col(f"`{arrival}`").asc_nulls_last(), *[_sortable(df, c).asc_nulls_last() for c in rest]
    )
    return df.withColumn(rank, F.row_number().over(w))


def first_copies(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The first copy of each message, with all its columns."""
    rank = fresh("copy_rank", df)
    return ranked(df, keys, arrival, rank).where(F.col(rank) == 1).drop(rank)


def repeated(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The identifiers that have a second copy, each once."""
    rank = fresh("copy_rank", df)
    return ranked(df, keys, arrival, rank).where(F.col(rank) == 2).select(*[f"`{k}`" for k in keys])


def unseen(batch: DataFrame, stored: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The first copies in ``batch`` of messages whose identifier isn't in ``stored``.

    Both sides come to the join with one row per identifier of the batch, or of the store, so no identifier is
    hot there. Appending the result to the store and running again gives nothing: the step is idempotent.
    """
    first = first_copies(batch, keys, arrival)
    ids = stored.select(*[f"`{k}`" for k in keys])
    renamed = ids.toDF(*[f"stored_{i}" for i in range(len(keys))])
    same = reduce(
        lambda x, y: x & y,
        [first[f"`{k}`"].eqNullSafe(renamed[f"stored_{i}"]) for i, k in enumerate(keys)],
    )
    return first.join(renamed, same, "left_anti")
