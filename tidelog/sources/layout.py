"""A stored layout of the log in which a window's scan reads only the folders it needs.

The time of a change is a uuid whose text has no useful order, so a window can't be pushed down to plain files. Stored
by day of the change and by a bucket of the stream, a window is a filter on folders, and so is a short list of streams.
Within a file rows are sorted by stream, which makes the file's own statistics useful.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu
from tidelog.operators.windows import scan
from tidelog.sources.cdclog import NOTE, stored_buckets
from tidelog.sources.manifest import _fs

DAY_MS = 86_400_000
BUCKETS = 64
#: Rows of one day and bucket are spread over so many tasks, so that a hot stream doesn't make one huge file.
SPREAD = 4


def _bucket(stream: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stream), F.lit(buckets)).cast("int")


def store(log: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Write ``log`` by ``log_day`` (days since 1970, null for rows without a time) and ``log_bucket``, of which there must always
    be as many; the number is noted beside the folders."""
    noted = stored_buckets(path)
    if mode == "append" and noted not in (None, buckets):
        raise ValueError(f"{path} has {noted} buckets")
    rows = log.withColumn("log_day", tu.floor_div(tu.millis(F.col("cdc$time")), DAY_MS)).withColumn("log_bucket", _bucket(F.col("cdc$stream_id"), buckets))
    spread = F.pmod(F.xxhash64("cdc$time"), F.lit(SPREAD))
    (
        rows.repartition("log_day", "log_bucket", spread)
        .sortWithinPartitions("log_day", "log_bucket", "cdc$stream_id")
        .write.partitionBy("log_day", "log_bucket").mode(mode).parquet(path)
    )
    fs, _, at = _fs(log.sparkSession, path)
    out = fs.create(at(f"{path}/{NOTE}"), True)
    out.write(json.dumps({"buckets": buckets}).encode())
    out.close()


def stored_scan(spark: SparkSession, path: str, start_ms: int, end_ms: int, streams: list[bytes] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the window ``(start, end]``, of ``streams`` if given, from a layout with that number of buckets."""
    rows = spark.read.parquet(path).where(F.col("log_day").between(start_ms // DAY_MS, end_ms // DAY_MS))
    if streams:
        wanted = {r[0] for r in spark.createDataFrame([(s,) for s in streams], "s binary").select(_bucket(F.col("s"), buckets)).collect()}
        rows = rows.where(F.col("log_bucket").isin(*sorted(wanted)))
    return scan(rows, start_ms, end_ms, streams).drop("log_day", "log_bucket")
