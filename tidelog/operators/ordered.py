"""Operators that depend on the order of changes within a stream: range pairing and postimages.

Both ask for the row just before, of some kind, in its stream. With ``slice_us`` a stream is cut into slices of time, each
ordered in a partition of its own, and only the last row of a slice is handed to the next non-empty one; so a stream with a
third of all rows is ordered by many tasks. Without it the stream columns must name something small, such as one batch of writes.

Nulls: rows without a time (the first of ``order``) come first in their stream. Ties are in the order of ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timeuuid import floor_div
from tidelog.session import fresh

DAY_US = 86_400_000_000


def with_previous(
    rows: DataFrame, stream: Sequence[str], order: Sequence[str], keep: Sequence[str], name: str, slice_us: int | None = None
) -> DataFrame:
    """``rows`` with struct ``name``: ``keep`` of the row before in its stream, or null. ``order[0]`` is in microseconds
    if ``slice_us`` is given."""
    packed = F.struct(*keep)
    if slice_us is None:
        return rows.withColumn(name, F.lag(packed).over(Window.partitionBy(*stream).orderBy(*order)))
    part, first = fresh("time_slice", rows), fresh("slice_first", rows)
    rows = rows.withColumn(part, F.coalesce(floor_div(F.col(order[0]), slice_us), F.lit(-(2**62))))
    w = Window.partitionBy(*stream, part).orderBy(*order)
    inner = rows.withColumn(name, F.lag(packed).over(w)).withColumn(first, F.row_number().over(w) == 1)
    last = F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], packed.alias("kept")))
    ends = rows.groupBy(*stream, part).agg(last.alias("l"))
    before = F.lag("l.kept").over(Window.partitionBy(*[f"s{i}" for i in range(len(stream))]).orderBy("p"))
    edges = ends.select(*[F.col(s).alias(f"s{i}") for i, s in enumerate(stream)], F.col(part).alias("p"), "l").withColumn("edge", before).drop("l")
    same = inner[part] == edges["p"]
    for i, s in enumerate(stream):
        same = same & inner[s].eqNullSafe(edges[f"s{i}"])
    joined = inner.join(edges, same, "left")
    return joined.select(
        *[inner[c] for c in rows.columns if c != part], F.when(inner[first], edges["edge"]).otherwise(inner[name]).alias(name)
    )


def range_pairs(changes: DataFrame, stream: Sequence[str], order: Sequence[str], keep: Sequence[str], slice_us: int | None = None) -> DataFrame:
    """Each range end (op 7, 8) with struct ``start``: op and ``keep`` of the range start it takes.

    A start is remembered until an end takes it or a later start replaces it; other operations don't touch it. So among
    the range rows of a stream it is the row just before the end, if that is a start.
    """
    rows = with_previous(changes.where(F.col("op").between(5, 8)), stream, order, ["op", *keep], "start", slice_us)
    return rows.where(F.col("op").isin(7, 8) & F.col("start.op").isin(5, 6))


def range_orphans(changes: DataFrame, stream: Sequence[str], order: Sequence[str], slice_us: int | None = None) -> DataFrame:
    """Range ends without a start. A replay refuses them; this lists them."""
    rows = with_previous(changes.where(F.col("op").between(5, 8)), stream, order, ["op"], "before", slice_us)
    return rows.where(F.col("op").isin(7, 8) & ~F.coalesce(F.col("before.op").isin(5, 6), F.lit(False))).drop("before")


def postimages(changes: DataFrame, stream: Sequence[str], order: Sequence[str], keep: Sequence[str] = (), slice_us: int | None = None) -> DataFrame:
    """Each postimage row (op 9 and above) that directly follows an update or insert of its stream, as ``applied_op``, with
    op and ``keep`` of that row in struct ``cause``. Every other operation in between forgets the update."""
    rows = with_previous(changes, stream, order, ["op", *keep], "cause", slice_us)
    return rows.where((F.col("op") >= 9) & F.col("cause.op").isin(1, 2)).withColumn("applied_op", F.col("cause.op"))
