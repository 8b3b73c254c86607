"""K-slack reordering over a stream, with the buffer as keyed state.

Per key and period the buffer holds the events of the period (first copies) until the stream's clock, the greatest arrival
so far, has passed the period's end by the slack; then they're released in event-time order to a final aggregate that may depend
on order. At each batch before that, the period's provisional values come from the buffer.

The state is keyed by key, period and slice of the period, so a key with a third of all events is spread over its slices;
``merged`` puts the slices of a period together. Identifiers stay for ``forget_us`` after the release, so that an event that
comes again is counted as too late once; then the state is dropped, and what comes later still is counted anew.

The clock is a watermark whose column is dropped behind it, so it fires timers but filters no rows: batches may come in any
order of arrival. An event that comes after its period was released, or arrived beyond the bound, is counted as too late,
once. A source that doesn't deliver by arrival needs ``disorder_us``, by which release waits
longer; the bound stays. Without it, what is delivered after the release is too late, however early it arrived.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.functions.timeuuid import HOUR_US, floor_div
from tidelog.operators.lateness import SLACK_US, merged_gaps

#: How long identifiers stay after a release.
FORGET_US = 24 * HOUR_US

OUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("period_us", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()),
    T.StructField("longest_gap_us", T.LongType()), T.StructField("n_too_late", T.LongType()),
])


class _Buffer(StatefulProcessor):
    def __init__(self, period_us: int, slack_us: int, forget_us: int) -> None:
        self.period_us, self.slack_us, self.forget_us = period_us, slack_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", T.StructType([T.StructField("id", T.StringType())]), T.StructType([T.StructField("us", T.LongType())]))
        self.late = handle.getMapState("late", T.StructType([T.StructField("id", T.StringType())]), T.StructType([T.StructField("us", T.LongType())]))
        self.info = handle.getValueState("info", T.StructType([T.StructField("json", T.StringType())]))

    def _values(self) -> list[int | None]:
        times = sorted(v[0] for v in self.events.values())
        gaps = [b - a for a, b in zip(times, times[1:])]
        return [len(times), times[0] if times else None, times[-1] if times else None, max(gaps, default=0)]

    def _row(self, key, status: str, info: dict) -> pd.DataFrame:
        row = (key[0], key[1], key[2], status, *(info["final"] or self._values()), info["too_late"])
        return pd.DataFrame([row], columns=OUT.names).astype({"first_us": "Int64", "last_us": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        info = json.loads(self.info.get()[0]) if self.info.exists() else {"final": None, "too_late": 0}
        before = info["too_late"]
        bound = key[1] + self.period_us + self.slack_us
        for frame in rows:
            frame = frame.sort_values("arrived_us", kind="stable").drop_duplicates("id")
            for ident, us, arrived in zip(frame["id"].tolist(), frame["us"].tolist(), frame["arrived_us"].tolist(), strict=True):
                if self.events.containsKey((ident,)):
                    continue
                late = self.late.containsKey((ident,))
                if not info["final"] and arrived <= bound:
                    self.events.updateValue((ident,), (us,))
                    if late:  # its first copy is delivered after a later one
                        self.late.removeKey((ident,))
                        info["too_late"] -= 1
                elif not late:
                    self.late.updateValue((ident,), (us,))
                    info["too_late"] += 1
        if not self.info.exists():
            self.handle.registerTimer(bound // 1000 + 1)
        if not info["final"]:
            yield self._row(key, "provisional", info)
        elif info["too_late"] != before:
            yield self._row(key, "too_late", info)
        self.info.update((json.dumps(info),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        info = json.loads(self.info.get()[0])
        if info["final"]:
            for state in (self.events, self.late, self.info):
                state.clear()
            return
        self.handle.registerTimer((key[1] + self.period_us + self.slack_us + self.forget_us) // 1000 + 2)
        info["final"] = self._values()
        yield self._row(key, "final", info)
        self.info.update((json.dumps(info),))

    def close(self) -> None:
        pass


def kslack(
    events: DataFrame, key: str, period_us: int = HOUR_US, slack_us: int = SLACK_US, disorder_us: int = 0, slices: int = 1, forget_us: int = FORGET_US
) -> DataFrame:
    """Provisional and final aggregates per ``key``, period and slice of a streaming ``events`` (``key``, id, us, arrived_us).

    The clock is the greatest arrival less ``disorder_us``, the most by which a row is delivered after later arrivals.
    Provisional rows come with every batch that touches a slice, the final one once, and after it a too_late row with the
    final values whenever n_too_late grows. Needs the RocksDB state store.
    """
    period = floor_div(F.col("us"), period_us) * F.lit(period_us)
    part = floor_div(F.col("us") - F.col("period_us"), -(-period_us // slices)).cast("int")
    rows = events.where("us is not null and arrived_us is not null").select(
        F.col(key).cast("string").alias("key"), period.alias("period_us"), "id", "us", "arrived_us", F.timestamp_micros("arrived_us").alias("arrival"),
    )
    return (
        rows.withColumn("slice", part)
        .withWatermark("arrival", f"{-(-disorder_us // 1000)} milliseconds")
        .drop("arrival")
        .groupBy("key", "period_us", "slice")
        .transformWithStateInPandas(_Buffer(period_us, slack_us, forget_us), OUT, "update", "EventTime")
    )


def merged(slices: DataFrame) -> DataFrame:
    """The values of whole periods from the last rows of their slices (at most as many as there are slices)."""
    piece = F.struct("first_us", "last_us", "longest_gap_us")
    whole = slices.groupBy("key", "period_us").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.collect_list(piece).alias("pieces"), F.sum("n_too_late").alias("n_too_late")
    )
    gap = merged_gaps(F.col("pieces"), "first_us", "last_us", "longest_gap_us").alias("longest_gap_us")
    return whole.select("key", "period_us", "n", "first_us", "last_us", gap, "n_too_late")
