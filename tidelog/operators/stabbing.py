"""For each point the greatest weight of the intervals that cover it, without forming pairs.

Points and interval ends are sorted together by partition key and place and cut into slabs by range partitioning, which
cuts inside a partition key as readily as between two, so one with a third of all rows is spread over a third of the slabs.
An interval acts within the slabs of its two ends; a slab that lies between them has one partition key only and is covered
whole, so of all intervals over it one maximum takes part. Slabs are as many as rows need, ``SLAB_ROWS`` each.

Within a slab points are numbered in order and intervals are ranges of numbers. A range is the union of two ranges of the
same power of two, so maxima are kept per power of two and handed down, halved, to the next smaller one: O(n log n) in
array steps, with any types of keys, as only Spark compares these.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import fresh, shared_checkpoint

POINT, OPEN, CLOSE, WHOLE = 0, 1, 2, 3
SLAB_ROWS = 400_000
LOWEST = -(2**63)


def place(df: DataFrame, ck: Sequence[str]) -> Column:
    """The place of a row among the interval ends of ``fold.range_bounds``: flag 0 with each clustering value, side 0."""
    parts = [F.struct(F.lit(0).alias("flag"), F.col(c).alias("value")).alias(f"p{i}") for i, c in enumerate(ck)]
    return F.struct(*parts, F.lit(0).alias("side"))


def cover_max(rows: DataFrame, intervals: DataFrame, name: str, pk: Sequence[str], ck: Sequence[str], most_rows: int | None = None) -> DataFrame:
    """``rows`` (``pk``, ``ck``, ...) with ``name``: the greatest ``us`` of the ``intervals`` (``pk``, lo, hi, us) over ``ck``.

    Null without an interval; a row with a null in ``pk`` or ``ck`` lies in none. No intervals at all give nulls, without a
    shuffle of the rows. ``most_rows`` is a bound of rows and interval ends, if the caller knows one; else they are counted.
    """
    if intervals.isEmpty():
        return rows.withColumn(name, F.lit(None).cast("long"))
    spark = rows.sparkSession
    keys = [f"k{i}" for i in range(len(pk))]
    points = rows.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(pk, keys, strict=True)], place(rows, ck).alias("at"), F.lit(POINT).alias("kind"),
        F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("id"), F.struct(*[f"`{c}`" for c in rows.columns]).alias("row"),
    )
    # Equal intervals are one; an id that follows from the interval survives a task's second run.
    ends = intervals.groupBy(*pk, "lo", "hi").agg(F.max("us").alias("us")).withColumn("id", F.xxhash64(*pk, "lo", "hi"))
    both_ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(OPEN).alias("kind")), F.struct(F.col("hi").alias("at"), F.lit(CLOSE).alias("kind")))
    marks = ends.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(pk, keys, strict=True)], "us", "id", F.explode(both_ends).alias("m"))
    marks = marks.select(*keys, "m.at", "m.kind", "us", "id")
    both = points.unionByName(marks, allowMissingColumns=True)
    most_rows = both.count() if most_rows is None else most_rows
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most_rows // SLAB_ROWS))
    # The id splits ends that share a place.
    slabs = both.repartitionByRange(n, *keys, "at", "id").sortWithinPartitions(*keys, "at", "id")
    slabs = shared_checkpoint(slabs.select("*", F.spark_partition_id().alias("slab"), F.monotonically_increasing_id().alias("pos")))
    spans = slabs.where(F.col("kind") != POINT).groupBy("id").agg(F.min("slab").alias("first"), F.max("slab").alias("last"), F.max("us").alias("us"))
    whole = (
        spans.where("last > first + 1")
        .select("us", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("slab"))
        .groupBy("slab")
        .agg(F.max("us").alias("us"))
        .select("slab", "us", F.lit(WHOLE).alias("kind"))
    )
    work = slabs.select("slab", "pos", *keys, "kind", "us", "id", "row").unionByName(whole, allowMissingColumns=True)
    found = fresh("cover_found", rows)
    swept = work.groupBy("slab").applyInArrow(_sweeper(found, len(keys)), T.StructType([*rows.schema.fields, T.StructField(found, T.LongType())]))
    whole_key = F.lit(True)
    for c in (*pk, *ck):
        whole_key = whole_key & F.col(f"`{c}`").isNotNull()
    return swept.select(*[f"`{c}`" for c in rows.columns], F.when(whole_key, F.col(found)).alias(name))


def range_max(n: int, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each number below ``n`` the greatest weight of the ranges ``lo <= i < hi`` over it, ``LOWEST`` without one."""
    some = hi > lo
    lo, hi, weight = lo[some], hi[some], weight[some]
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1 if len(lo) else np.zeros(0, dtype=np.int64)
    best = np.full(n, LOWEST, dtype=np.int64)
    for k in range(int(level.max(initial=0)), -1, -1):
        half = 1 << k
        if half < n:
            lower = best.copy()
            np.maximum(lower[half:], best[:-half], out=lower[half:])
            best = lower
        at = level == k
        np.maximum.at(best, lo[at], weight[at])
        np.maximum.at(best, hi[at] - half, weight[at])
    return best


def _runs(table: pa.Table, n_keys: int) -> np.ndarray:
    """The number of the partition key's run that each row of the sorted table is in."""
    new = np.zeros(table.num_rows, dtype=bool)
    for i in range(n_keys):
        c = table[f"k{i}"].combine_chunks()
        if len(c) > 1:
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _sweeper(name: str, n_keys: int):
    def sweep(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        floor = pc.max(table["us"].filter(pa.array(kind == WHOLE))).as_py()
        table = table.filter(pa.array(kind != WHOLE)).sort_by("pos")
        kind = table["kind"].to_numpy()
        us, ident = (table[c].fill_null(0).to_numpy() for c in ("us", "id"))
        point = kind == POINT
        before = np.cumsum(point) - point
        run = _runs(table, n_keys)
        edges = np.concatenate([np.flatnonzero(np.diff(run, prepend=-1)), [len(run)]])
        counts = np.concatenate([before, [int(point.sum())]])
        begin, end = counts[edges[:-1]][run], counts[edges[1:]][run]
        opens, closes = np.flatnonzero(kind == OPEN), np.flatnonzero(kind == CLOSE)
        _, a, b = np.intersect1d(ident[opens], ident[closes], assume_unique=True, return_indices=True)
        pairs = opens[a], closes[b]
        leaving, entering = np.delete(opens, a), np.delete(closes, b)
        lo = np.concatenate([before[pairs[0]], before[leaving], begin[entering]])
        hi = np.concatenate([before[pairs[1]], end[leaving], before[entering]])
        best = range_max(int(point.sum()), lo, hi, np.concatenate([us[pairs[0]], us[leaving], us[entering]]))
        if floor is not None:
            best = np.maximum(best, floor)
        result = pa.Table.from_struct_array(table["row"].filter(pa.array(point)).combine_chunks())
        return result.append_column(name, pa.array(best, mask=best == LOWEST))

    return sweep
