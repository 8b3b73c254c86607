"""Generations of streams: each is in effect from its start to the next one's.

The list of generations is as long as the history of the cluster's topology, a few rows a year; ordering it as a whole
needs no partitioning. Rows without a start are no generation; rows of equal start are one. All times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu

SETTLE_US = 30_000_000


def starts(generations: DataFrame) -> DataFrame:
    """(start_us) of each generation; reads only the time column."""
    return generations.select(tu.epoch_us(generations, "time").alias("start_us")).where("start_us is not null").distinct()


def generations_of(generations: DataFrame, now_us: int | None = None) -> DataFrame:
    """(start_us, end_us): the end is the next start, null while open. With ``now_us``, only those started 30 s before it."""
    found = starts(generations).withColumn("end_us", F.lead("start_us").over(Window.orderBy("start_us")))
    return found if now_us is None else found.where(F.col("start_us") <= now_us - SETTLE_US)


def next_generation(generations: DataFrame, after_us: int) -> DataFrame:
    """The first generation strictly after ``after_us`` with its end; no row if there is none."""
    two = F.slice(F.array_sort(F.collect_set("start_us")), 1, 2)
    return (
        starts(generations)
        .where(F.col("start_us") > after_us)
        .agg(two.alias("two"))
        .where(F.size("two") > 0)
        .select(F.try_element_at("two", F.lit(1)).alias("start_us"), F.try_element_at("two", F.lit(2)).alias("end_us"))
    )


def generation_end(generations: DataFrame, start_us: int) -> DataFrame:
    """One row (end_us): the least start strictly after ``start_us``, or null."""
    return starts(generations).where(F.col("start_us") > start_us).agg(F.min("start_us").alias("end_us"))


def streams_of(generations: DataFrame, start_us: int | None = None) -> DataFrame:
    """(start_us, stream_id) of all generations, or of the one that starts at ``start_us``; an empty set gives no rows."""
    rows = generations.select(tu.epoch_us(generations, "time").alias("start_us"), "streams").where("start_us is not null")
    if start_us is not None:
        rows = rows.where(F.col("start_us") == start_us)
    return rows.select("start_us", F.explode("streams").alias("stream_id")).where("stream_id is not null").distinct()
