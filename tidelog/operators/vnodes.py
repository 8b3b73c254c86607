"""Assigning streams to the ranges of the token ring.

A stream belongs to the smallest ring token not below its own; those above the last token and those up to the first go
together in the wrap-around group. The ring is a few hundred tokens per node; up to ``MAX_RING`` tokens, counted, are sent to all
tasks. A longer ring is merged with the streams: both are sorted together in slices of the token range, and a slice without
a token above takes the first one of the slices after it.

An empty ring gives no groups. A stream without a token belongs to no group; repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import within

MAX_RING = 1_000_000
SLICE_BITS = 16


def stream_vnodes(streams: DataFrame, ring: DataFrame, max_ring: int = MAX_RING) -> DataFrame:
    """(stream_id, token, vnode_token, wraparound) of ``streams`` (stream_id, token) on ``ring`` (token)."""
    tokens = ring.select("token").dropna().distinct()
    found = streams.select("stream_id", "token").dropna().distinct()
    if not within(tokens, max_ring):
        return _merged(found, tokens)
    ends = np.sort(tokens.toPandas()["token"].to_numpy(dtype=np.int64))
    if not len(ends):
        return found.where(F.lit(False)).select("*", F.lit(0).cast("long").alias("vnode_token"), F.lit(True).alias("wraparound"))

    @F.pandas_udf("long")
    def vnode(token: pd.Series) -> pd.Series:
        at = np.searchsorted(ends, token.to_numpy(dtype=np.int64), side="left")
        return pd.Series(ends[np.where(at == len(ends), 0, at)])

    return found.withColumn("vnode_token", vnode("token")).withColumn("wraparound", F.col("vnode_token") == int(ends[0]))


def _merged(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """``stream_vnodes`` for a ring of any size: tokens and streams in one order, cut into slices of equal width."""
    part = F.shiftright(F.col("token"), 64 - SLICE_BITS).alias("part")
    both = found.select("stream_id", "token", F.lit(None).cast("long").alias("end")).unionByName(tokens.select(F.lit(None).cast("binary").alias("stream_id"), "token", F.col("token").alias("end")))
    # Slices have one row each below, at most 2 ** SLICE_BITS.
    firsts = tokens.groupBy(part).agg(F.min("token").alias("first"))
    parts = found.select(part).union(firsts.select("part")).distinct().join(firsts, "part", "left")
    later = F.min("first").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    nexts = parts.select("part", later.alias("next_first"))
    least = tokens.agg(F.min("token")).scalar()
    # A ring token equal to a stream's own is the stream's, so ring tokens come after streams of their token.
    w = Window.partitionBy("part").orderBy(F.col("token"), F.col("end").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    ranked = both.withColumn("part", part).withColumn("own", F.min("end").over(w)).where("stream_id is not null")
    joined = ranked.join(F.broadcast(nexts), "part")
    vnode = F.coalesce("own", "next_first", least)
    return joined.select("stream_id", "token", vnode.alias("vnode_token"), (vnode == least).alias("wraparound")).where("vnode_token is not null")


def tasks(assigned: DataFrame) -> DataFrame:
    """(vnode_token, wraparound, n_streams, first_stream, streams): one row per group, its streams sorted."""
    return (
        assigned.groupBy("vnode_token", "wraparound")
        .agg(F.array_sort(F.collect_set("stream_id")).alias("streams"))
        .select(
            "vnode_token", "wraparound", F.size("streams").cast("long").alias("n_streams"),
            F.hex(F.try_element_at("streams", F.lit(1))).alias("first_stream"), "streams",
        )
    )


def task_label(first_stream: Column) -> Column:
    """How a task is printed: its first stream, or 'empty task'."""
    return F.coalesce(first_stream, F.lit("empty task"))
