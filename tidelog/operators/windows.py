"""Reading a log in bounded time windows ``(start, end]`` that stay behind the clock.

Bounds are whole milliseconds and mean their last tick: a window holds the changes after the last tick of its start up to
the last tick of its end, so windows tile without gap or overlap. The clock is always passed in.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu

LATE_MS = 10_000
LIMIT_MS = 30_000
#: Waits after a cropped window, a read one, and an empty or missing one.
PACE_MS = {"cropped": 1_000, "read": 10_000, "idle": 30_000}


@dataclass(frozen=True)
class FetchWindow:
    start_ms: int
    end_ms: int
    cropped: bool = False
    last: bool = False

    def __str__(self) -> str:
        return f"({self.start_ms}, {self.end_ms}]" + "(cropped)" * self.cropped


def create_window(start_ms: int, end_ms: int | None, now_ms: int) -> FetchWindow | None:
    """What can be read after ``start_ms`` of a generation that ends at ``end_ms`` (None: open); None if it's too early."""
    safe = now_ms - LATE_MS
    if safe < start_ms:
        return None
    if end_ms is not None and safe >= end_ms:
        return FetchWindow(start_ms, end_ms, last=True)
    return FetchWindow(start_ms, safe)


def crop_window(w: FetchWindow) -> FetchWindow:
    """At most 30 s, except from the epoch."""
    if w.start_ms > 0 and w.end_ms - w.start_ms > LIMIT_MS:
        return replace(w, end_ms=w.start_ms + LIMIT_MS, cropped=True, last=False)
    return w


def compute_window(start_ms: int, end_ms: int | None, now_ms: int) -> FetchWindow | None:
    w = create_window(start_ms, end_ms, now_ms)
    return w and crop_window(w)


def pace_column(window: Column, empty: Column) -> Column:
    """Milliseconds to wait after a window (a struct as of ``window_column``, or null) that was ``empty`` or not."""
    idle = window.isNull() | (empty & ~window["cropped"])
    return F.when(idle, PACE_MS["idle"]).when(window["cropped"], PACE_MS["cropped"]).otherwise(PACE_MS["read"])


def window_column(start_ms: Column, end_ms: Column, now_ms: Column) -> Column:
    """``compute_window`` as a struct column (start_ms, end_ms, cropped, last); null where there is none."""
    safe = now_ms - F.lit(LATE_MS)
    ends = end_ms.isNotNull() & (safe >= end_ms)
    until = F.when(ends, end_ms).otherwise(safe)
    cropped = (start_ms > 0) & (until - start_ms > LIMIT_MS)
    return F.when(
        safe >= start_ms,
        F.struct(
            start_ms.alias("start_ms"),
            F.when(cropped, start_ms + F.lit(LIMIT_MS)).otherwise(until).alias("end_ms"),
            cropped.alias("cropped"),
            (ends & ~cropped).alias("last"),
        ),
    )


def in_window(time: Column, start_ms: int, end_ms: int) -> Column:
    """The half-open range as a predicate on a uuid column."""
    t = tu.ticks(time)
    return (t > start_ms * 10_000 + 9_999) & (t <= end_ms * 10_000 + 9_999)


def scan(log: DataFrame, start_ms: int, end_ms: int, streams: DataFrame | list[bytes] | None = None) -> DataFrame:
    """The log's rows in a window, of some streams: a list is pushed to the scan, a table is a semi-join."""
    rows = log.where(in_window(F.col("cdc$time"), start_ms, end_ms))
    if streams is None:
        return rows
    if isinstance(streams, list):
        return rows.where(F.col("cdc$stream_id").isin(*[F.lit(s) for s in streams])) if streams else rows.where(F.lit(False))
    ids = streams.select(F.col("stream_id").alias("task_stream_id"))
    return rows.join(ids, F.col("cdc$stream_id") == F.col("task_stream_id"), "left_semi")


def bucket(ms: Column, origin_ms: int, length_ms: int = LIMIT_MS) -> Column:
    """Number of the window ``(origin + (n-1) * length, origin + n * length]`` that holds ``ms``."""
    return tu.floor_div(ms - F.lit(origin_ms) + F.lit(length_ms - 1), length_ms)


def window_counts(log: DataFrame, origin_ms: int, length_ms: int = LIMIT_MS) -> DataFrame:
    """(stream_id, bucket, n): changes of each stream in each window that has any."""
    rows = log.select(F.hex("cdc$stream_id").alias("stream_id"), bucket(tu.millis(F.col("cdc$time")), origin_ms, length_ms).alias("bucket"))
    return rows.where("bucket is not null").groupBy("stream_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def running_total(counts: DataFrame) -> DataFrame:
    """``total``: changes of the stream up to and with the window. Sorted per stream, over windows and not changes."""
    w = Window.partitionBy("stream_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum("n").over(w))


def last_non_empty(counts: DataFrame) -> DataFrame:
    """(stream_id, last_bucket): the latest window of each stream with changes; a mergeable maximum."""
    return counts.groupBy("stream_id").agg(F.max("bucket").alias("last_bucket"))
