"""Per-period aggregates by event time that late records correct, up to a limit.

K-slack by arrival: an event waits in a buffer until its period's end plus the lateness bound has passed on the arrival
clock; then its period is released, in event-time order, to a final aggregate that may depend on that order. Until then
the period's value comes from what the buffer holds and is provisional. Whatever arrives later is too late.

Over a whole log the clock at an event's arrival is that arrival, since rows are taken in order of arrival. So what the buffer
takes in is known per event (``buffered``), and the buffer itself is Spark's sort, which spills: ``released`` puts the events
that were let in into event-time order, in partitions of one key, period and slice of the period, and the final aggregate runs
over that order. A slice hands its first and last event to the next one, so a key with a third of all events is sorted by many
tasks. ``tidelog.streaming.kslack`` is the same over a stream, with the buffer as keyed state.

Nulls: an event without a time or an arrival belongs to no period and is left out; a null key is a key. Repeated rows count
once, by their earliest arrival. Ties: events of one time are released in order of their identifiers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timeuuid import HOUR_US, floor_div

SLACK_US = 6 * HOUR_US
#: Slices of a period that are ordered apart from each other.
SLICES = 64
ON_TIME, CORRECTION, TOO_LATE = "on_time", "correction", "too_late"


def buffered(
    df: DataFrame, keys: Sequence[str], time_us: str, arrival_us: str, period_us: int = HOUR_US, slack_us: int = SLACK_US
) -> DataFrame:
    """One row per event: keys, ``time_us``, ``period_us``, ``first_us``, ``release_us``, ``slice`` and ``fate``.

    ``period_us`` is the period's start, ``slice`` a part of it, ``first_us`` the earliest arrival, ``release_us`` when the
    buffer lets the period go. ``fate`` is on_time before the period's end, correction from then until the release
    (inclusive), and too_late after it.
    """
    start = floor_div(F.col(time_us), period_us) * F.lit(period_us)
    end = F.col("period_us") + F.lit(period_us)
    return (
        df.groupBy(*keys, time_us)
        .agg(F.min(arrival_us).alias("first_us"))
        .where(F.col(time_us).isNotNull() & F.col("first_us").isNotNull())
        .withColumn("period_us", start)
        .withColumn("release_us", end + F.lit(slack_us))
        .withColumn("slice", floor_div(F.col(time_us) - F.col("period_us"), max(1, -(-period_us // SLICES))).cast("int"))
        .withColumn(
            "fate",
            F.when(F.col("first_us") < end, ON_TIME)
            .when(F.col("first_us") <= F.col("release_us"), CORRECTION)
            .otherwise(TOO_LATE),
        )
    )


def released(events: DataFrame, by: Sequence[str], keys: Sequence[str], time_us: str) -> DataFrame:
    """The events that the buffer let in, as it lets them go: with ``released_no``, their place in the event-time order of
    their ``by``, period and slice, from 1."""
    w = Window.partitionBy(*by, "period_us", "slice").orderBy(time_us, *keys)
    return events.where(F.col("fate") != TOO_LATE).withColumn("released_no", F.row_number().over(w))


def corrections(events: DataFrame, by: Sequence[str], keys: Sequence[str], time_us: str) -> DataFrame:
    """The released events that corrected a period after its end: read off the release."""
    rows = released(events, by, keys, time_us)
    return rows.where((F.col("fate") == CORRECTION) & (F.col("released_no") >= 1))


def merged_gaps(pieces: Column, first: str, last: str, gap: str) -> Column:
    """The longest gap of a whole from an array of its pieces (structs with least and greatest time and longest gap), in order."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("gap"))

    def step(a: Column, p: Column) -> Column:
        between = F.coalesce(p[first] - a["last"], F.lit(0).cast("long"))
        return F.struct(F.coalesce(p[last], a["last"]).alias("last"), F.greatest(a["gap"], F.coalesce(p[gap], F.lit(0).cast("long")), between).alias("gap"))

    return F.aggregate(F.array_sort(F.filter(pieces, lambda p: p[first].isNotNull())), start, step)["gap"]


def per_period(events: DataFrame, by: Sequence[str], time_us: str) -> DataFrame:
    """Per ``by`` and period: provisional count and longest gap at the period's end, corrections, final count, first and last
    event time and longest gap between events, and the too-late count.

    Events of one time are added up first, in the map tasks; times are then ordered per slice, and slices per period.
    """

    def count(*fates: str):
        return F.sum(F.col("fate").isin(*fates).cast("long"))

    counts = ["n_provisional", "n_corrections", "n_too_late"]
    times = events.groupBy(*by, "period_us", "slice", time_us).agg(
        count(ON_TIME).alias("n_provisional"), count(CORRECTION).alias("n_corrections"), count(TOO_LATE).alias("n_too_late")
    )
    t = F.col(time_us)
    let_in = F.when(F.col("n_provisional") + F.col("n_corrections") > 0, t)
    early = F.when(F.col("n_provisional") > 0, t)
    before = Window.partitionBy(*by, "period_us", "slice").orderBy(time_us).rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumns({
        "let_in": let_in, "early": early,
        "gap": let_in - F.last(let_in, ignorenulls=True).over(before), "early_gap": early - F.last(early, ignorenulls=True).over(before),
    })
    slices = times.groupBy(*by, "period_us", "slice").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.struct(F.min("let_in").alias("first"), F.max("let_in").alias("last"), F.max("gap").alias("gap")).alias("final"),
        F.struct(F.min("early").alias("first"), F.max("early").alias("last"), F.max("early_gap").alias("gap")).alias("provisional"),
    )
    whole = slices.groupBy(*by, "period_us").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.min("final.first").alias("first_event_us"), F.max("final.last").alias("last_event_us"),
        F.collect_list("final").alias("finals"), F.collect_list("provisional").alias("provisionals"),  # at most SLICES each
    )
    return whole.select(
        *by, "period_us", "n_provisional", "n_corrections", (F.col("n_provisional") + F.col("n_corrections")).alias("n_final"), "n_too_late",
        "first_event_us", "last_event_us",
        merged_gaps(F.col("provisionals"), "first", "last", "gap").alias("provisional_gap_us"),
        merged_gaps(F.col("finals"), "first", "last", "gap").alias("longest_gap_us"),
    )
