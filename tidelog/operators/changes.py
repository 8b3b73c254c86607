"""The keys of a change and its decoded times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu

KEYS = ["stream_id", "change_time", "batch_seq_no"]


def key_columns() -> list[Column]:
    """stream_id (upper-case hex), change_time (lower case) and batch_seq_no of a log row.

    Nulls stay null, and null keys equal each other wherever rows are grouped by key.
    """
    return [
        F.hex("cdc$stream_id").alias("stream_id"),
        F.lower("cdc$time").alias("change_time"),
        F.col("cdc$batch_seq_no").alias("batch_seq_no"),
    ]


def with_keys(log: DataFrame, *more: Column) -> DataFrame:
    """Only the key columns of ``log`` and ``more``, so that the scan reads nothing else."""
    return log.select(*key_columns(), *more)


def arrived_us(log: DataFrame) -> Column:
    return tu.epoch_us(log, "arrived_at")
