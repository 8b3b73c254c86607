"""Applying a stream of inserts, updates and deletes: a commutative fold.

Per row of the base table the state is a maximum of structs (write time, is deletion, value, ...) for each cell, for
the row's mark and for its deletions. A maximum may be taken in any order, over repeats, and over states: the map tasks
fold before the shuffle, base rows are just more input, and a tombstone stays in the state, so a change that comes after
it with an older time still loses.

Deletions of whole partitions and of ranges are kept beside the rows and applied when the state is read.

Nulls: a change without a time, without an operation or without pk changes nothing. A null clustering column is a value of its own that no
range covers. Ties: equal write times go to a deletion, then to the greater value, then to the longer life, then to the
greater change time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu
from tidelog.model import TableSpec
from tidelog.operators.ordered import range_pairs
from tidelog.operators.skew import salted_left
from tidelog.operators.stabbing import cover_max

NEVER = 2**63 - 1
LOWEST = -(2**63)


def _cell(name: str) -> Column:
    """The write that this change makes to column ``name``; null if it leaves it alone."""
    value, flag = F.col(name), F.coalesce(F.col(f"cdc$deleted_{name}"), F.lit(False))
    touched = F.col("op").isin(1, 2) & (value.isNotNull() | flag)
    gone = value.isNull()
    return F.when(
        touched,
        F.struct(
            F.col("us"),
            gone.alias("gone"),
            value.alias("value"),
            F.when(gone, F.lit(NEVER)).otherwise(F.col("expire_us")).alias("expire_us"),
            F.col("change_time"),
        ),
    )


def row_states(changes: DataFrame, pk: Sequence[str], ck: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fold decoded changes (op, us, expire_us, change_time and the table's columns) to one state per row.

    Columns: ``pk``, ``ck``, ``mark`` struct(us, expire_us), ``row_deleted_us``, and a struct per column.
    """
    mark = F.when(F.col("op") == 2, F.struct("us", "expire_us"))
    dead = F.when(F.col("op") == 3, F.col("us"))
    return (
        changes.where(F.col("op").isin(1, 2, 3) & F.col("us").isNotNull() & F.col(pk[0]).isNotNull())
        .select(*pk, *ck, mark.alias("mark"), dead.alias("row_deleted_us"), *[_cell(c).alias(c) for c in columns])
        .groupBy(*pk, *ck)
        .agg(*[F.max(c).alias(c) for c in ("mark", "row_deleted_us", *columns)])
    )


def merge_states(a: DataFrame, b: DataFrame, pk: Sequence[str], ck: Sequence[str]) -> DataFrame:
    """The state of both inputs together; the same maximum, so base rows, late and repeated batches are all alike."""
    rest = [c for c in a.columns if c not in {*pk, *ck}]
    return a.unionByName(b).groupBy(*pk, *ck).agg(*[F.max(c).alias(c) for c in rest])


def partition_tombstones(changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """(pk, partition_deleted_us): the latest deletion of each whole partition."""
    return (
        changes.where((F.col("op") == 4) & F.col("us").isNotNull() & F.col(pk[0]).isNotNull())
        .groupBy(*pk)
        .agg(F.max("us").alias("partition_deleted_us"))
    )


def with_partition_tombstones(rows: DataFrame, tombstones: DataFrame, pk: Sequence[str], ck: Sequence[str]) -> DataFrame:
    """The rows with the deletion of their partition; one with very many rows is spread over several tasks."""
    return salted_left(rows, tombstones, pk, ck)


def paired_ranges(changes: DataFrame, stream: Sequence[str], order: str, pk: Sequence[str], ck: Sequence[str]) -> DataFrame:
    """Range deletes: each end (7, 8) with the start (5, 6) just before it among the range rows of its ``stream`` columns.

    A later start replaces an earlier one, a start without an end and an end without a start give nothing. One batch of
    writes is one group, which the database keeps small; copies must have been removed.
    """
    known = F.col("us").isNotNull()
    same = F.lit(True)
    for c in pk:
        known = known & F.col(f"`{c}`").isNotNull()
        same = same & (F.col(f"start.`{c}`") == F.col(f"`{c}`"))
    rows = changes.where(known).select(*stream, order, "op", *pk, *ck, "us")
    return range_pairs(rows, stream, [order], [*pk, *ck]).where(same)


def range_bounds(pairs: DataFrame, pk: Sequence[str], ck: Sequence[str]) -> DataFrame:
    """(``pk``, lo, hi, us): each range delete as an open interval of places as ``stabbing.place`` has them.

    A range fixes the leading clustering columns up to the last one that either bound names, and bounds that one; a bound that
    doesn't name it is open. A bound lies just before (flag or side -1) or just after (1) all rows that share its columns, so
    none ties with a row. Bounds that differ before their last column are no range, and neither are empty ones.
    """
    m = len(ck)
    start, end = [F.col(f"start.`{c}`") for c in ck], [F.col(f"`{c}`") for c in ck]
    none = [F.lit(None).cast(pairs.schema[c].dataType) for c in ck]

    def bound(d: int, value: Column, below: bool, included: Column) -> Column:
        """The bound at column ``d``: open where ``value`` is null."""
        outer, inner = (-1, 1) if below else (1, -1)
        flag = F.when(included, outer).otherwise(inner)

        def point(depth: int, given: Sequence[Column], mark: Column) -> Column:
            parts = [
                F.struct((F.lit(0) if i < depth else mark).cast("int").alias("flag"), (given[i] if i < depth else none[i]).alias("value")).alias(f"p{i}")
                for i in range(m)
            ]
            return F.struct(*parts, mark.cast("int").alias("side"))

        fixed = [F.coalesce(s, e) for s, e in zip(start[:d], end[:d], strict=True)]
        return F.when(value.isNull(), point(d, fixed, F.lit(outer))).otherwise(point(d + 1, [*fixed, value], flag))

    sound, lo, hi = F.lit(None).cast("boolean"), None, None
    for d in reversed(range(m)):
        here = start[d].isNotNull() | end[d].isNotNull() if d else F.lit(True)
        agree = F.lit(True)
        for s, e in zip(start[:d], end[:d], strict=True):
            agree = agree & (F.coalesce(s, e) == F.coalesce(e, s))
        one_lo, one_hi = bound(d, start[d], True, F.col("start.op") == 5), bound(d, end[d], False, F.col("op") == 7)
        lo = F.when(here, one_lo) if lo is None else lo.when(here, one_lo)
        hi = F.when(here, one_hi) if hi is None else hi.when(here, one_hi)
        sound = F.when(here, agree) if d == m - 1 else sound.when(here, agree)
    return pairs.where(F.coalesce(sound, F.lit(False))).select(*pk, lo.alias("lo"), hi.alias("hi"), "us").where(F.col("lo") < F.col("hi"))


def range_tombstones(changes: DataFrame, pk: Sequence[str], ck: Sequence[str]) -> DataFrame:
    """(``pk``, lo, hi, us) of the range deletes among decoded changes, copies counting once."""
    ranges = changes.where("op between 5 and 8").dropDuplicates(["stream_id", "change_time", "seq"])
    return range_bounds(paired_ranges(ranges, ["stream_id", "change_time"], "seq", pk, ck), pk, ck)


def live_rows(states: DataFrame, columns: Sequence[str], now_us: int, more: Column | None = None) -> DataFrame:
    """The rows that exist at ``now_us``, with column ``<c>_time``: the change that supplied c's present value, or ''.

    ``states`` has, beside the fold's columns, ``deleted_us``: the latest deletion that covers the row, or null. ``more`` is
    another reason for a row to exist.
    """
    dead = F.coalesce("deleted_us", F.lit(LOWEST))

    def void(c: str) -> Column:
        return F.col(f"{c}.us").isNull() | (F.col(f"{c}.expire_us") <= now_us) | (dead >= F.col(f"{c}.us"))

    gone = {c: void(c) | F.col(f"{c}.gone") for c in columns}
    exists = ~void("mark") if more is None else ~void("mark") | more
    for c in columns:
        exists = exists | ~gone[c]
    times = [F.when(gone[c], F.lit("")).otherwise(F.col(f"{c}.change_time")).alias(f"{c}_time") for c in columns]
    return states.where(exists).withColumns({f"{c}_time": t for c, t in zip(columns, times, strict=True)})


def decoded(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A log as the fold takes it: op, us, expire_us, change_time, stream_id, seq, and ``columns`` with their flags."""
    flags = [f for c in columns for f in (f"cdc$deleted_{c}", f"cdc$deleted_elements_{c}") if f in log.columns]
    return log.select(
        F.col("cdc$operation").cast("int").alias("op"),
        tu.micros(F.col("cdc$time")).alias("us"),
        F.col("cdc$ttl").alias("ttl"),
        F.lower("cdc$time").alias("change_time"),
        F.col("cdc$stream_id").alias("stream_id"),
        F.col("cdc$batch_seq_no").alias("seq"),
        *columns,
        *flags,
    ).withColumn("expire_us", F.when(F.col("ttl").isNull(), F.lit(NEVER)).otherwise(F.col("us") + F.col("ttl") * 1_000_000))


def current(log: DataFrame, spec: TableSpec, now_us: int) -> DataFrame:
    """The rows of the table that exist at ``now_us``, from its whole log; ranges only where there are clustering columns."""
    pk, ck, columns = spec.partition_key, spec.clustering_key, spec.columns
    changes = decoded(log, [*spec.primary_key, *columns])
    states = with_partition_tombstones(row_states(changes, pk, ck, columns), partition_tombstones(changes, pk), pk, ck)
    deleted = ["row_deleted_us", "partition_deleted_us"]
    if spec.ranges:
        states = cover_max(states, range_tombstones(changes, pk, ck), "range_deleted_us", pk, ck, most_rows=log.count())
        deleted.append("range_deleted_us")
    return live_rows(states.withColumn("deleted_us", F.greatest(*deleted)), columns, now_us)
