"""Topology events, the latest change of topology, and whether a generation's end must be looked up again.

Only a node that joins or leaves changes the topology; nodes going up or down, and registrations, don't. The latest change is
a mergeable maximum, so events may come in any order and repeatedly. Null times are no events; without events there has been
no change, and a generation that was never read had its last rows at time 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = ("add", "remove")
IDLE_MS = 10_000


def topology_changes(events: DataFrame, kind: str = "kind", time: str = "us") -> DataFrame:
    """The events that change the topology, letter case of ``kind`` aside."""
    return events.where(F.lower(kind).isin(*CHANGES) & F.col(time).isNotNull())


def last_topology_change(events: DataFrame, kind: str = "kind", time: str = "us") -> DataFrame:
    """One row (last_change_us); null without a change."""
    return topology_changes(events, kind, time).agg(F.max(time).alias("last_change_us"))


def refresh_needed(fetched_ms: Column, end_ms: Column, last_change_ms: Column, last_non_empty_ms: Column, now_ms: Column) -> Column:
    """True if the end is unknown, and it was fetched before the last change or no rows have come for 10 s."""
    stale = F.coalesce(fetched_ms < last_change_ms, F.lit(False)) | (F.coalesce(last_non_empty_ms, F.lit(0)) < now_ms - F.lit(IDLE_MS))
    return end_ms.isNull() & stale
