"""Filling containers of a fixed capacity with items of varying size.

One pass counts the items of each size; sizes don't exceed the capacity, so this histogram is bounded whatever the
corpus. From it alone the driver plans everything:

- dynamic programming chooses the bucket boundaries that minimise padding, every item counting as long as its bucket;
- token-budget batches are formed from the buckets, longest first. A batch begins with items of one bucket and what
  room remains is filled with items of shorter ones (best fit), for batches of a single bucket would leave, say, almost half
  of a container unused beside every item just longer than half of it.

The plan has a few entries per bucket. Items are then numbered within their bucket, and the number tells the container.

Numbering: an item's shard is a hash of its key, a bucket's items in one shard are ranked in one sorted partition,
and shards follow one another; a bucket with a third of all items is spread over all shards.

Null and empty texts have size 0; they take no room and are spread over the containers. An item above the capacity is cut
into full parts and a rest; nothing else is split. Repeated keys are separate items only if their rows differ in size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import shared_checkpoint

BUCKETS = 256
#: Up to so many different sizes, the costs of all cuts are held as one table (50 MB).
WHOLE_TABLE = 2500
SHARD_ROWS = 200_000


def optimal_boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """The at most ``buckets`` upper bounds, among ``sizes`` (ascending), with the least padding in all."""
    n = len(sizes)
    if n <= buckets:
        return sizes
    s, c = sizes.astype(np.float64), np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    w = np.concatenate([[0.0], np.cumsum(s * counts)])

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of sizes i..j-1 in one bucket that reaches up to sizes[j-1]."""
        return s[j - 1] * (c[j] - c[i]) - (w[j] - w[i])

    best = np.array([0.0] + [float(cost(np.array([0]), j)[0]) for j in range(1, n + 1)])
    choice = np.zeros((buckets, n + 1), dtype=np.int32)
    table = None
    if n <= WHOLE_TABLE:
        i, j = np.arange(n + 1)[None, :], np.arange(1, n + 1)[:, None]
        table = np.where(i < j, s[:, None] * (c[1:][:, None] - c[None, :]) - (w[1:][:, None] - w[None, :]), np.inf)
        total = np.empty_like(table)
    for k in range(1, buckets):
        new = np.full(n + 1, np.inf)
        if table is not None:
            np.add(table, best[None, :], out=total)
            choice[k, 1:] = total.argmin(axis=1)
            new[1:] = total[np.arange(n), choice[k, 1:]]
            new[0] = 0.0
            best = new
            continue
        # The best cut moves right as j does, so each half of the range needs only part of the cuts.
        todo = [(k + 1, n, k, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            cuts = np.arange(lo, min(hi, j - 1) + 1)
            total = best[cuts] + cost(cuts, j)
            at = int(np.argmin(total))
            new[j], choice[k, j] = total[at], cuts[at]
            todo += [(a, j - 1, lo, int(cuts[at])), (j + 1, b, int(cuts[at]), hi)]
        new[: k + 1] = best[: k + 1]
        for j in range(1, k + 1):
            choice[k, j] = choice[k - 1, j]
        best = new
    bounds, j, k = [], n, buckets - 1
    while j > 0:
        bounds.append(sizes[j - 1])
        j, k = int(choice[k, j]), k - 1
    return np.array(bounds[::-1])


@dataclass
class Plan:
    """Buckets by upper bound, and runs of items: those of bucket ``bucket`` numbered from ``begin`` on go to containers
    from ``container`` on, ``each`` to a container. Runs are sorted by bucket and begin."""

    bounds: np.ndarray
    bucket: np.ndarray
    begin: np.ndarray
    container: np.ndarray
    each: np.ndarray
    containers: int

    def place(self, bucket: np.ndarray, number: np.ndarray) -> np.ndarray:
        start = np.searchsorted(self.bucket, bucket, side="left")
        # Buckets in one sortable key with the number: numbers stay below 2**40 items per bucket.
        key = (self.bucket << 40) + self.begin
        run = np.maximum(np.searchsorted(key, (bucket << 40) + number, side="right") - 1, start)
        return self.container[run] + (number - self.begin[run]) // self.each[run]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> Plan:
    """Plan batches for a histogram of sizes 1 to ``capacity``."""
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    bounds = optimal_boundaries(sizes, counts, buckets).astype(np.int64)
    amount = np.zeros(len(bounds), dtype=np.int64)
    np.add.at(amount, np.searchsorted(bounds, sizes), counts)
    # Open batches by room left: a batch kind is [how many, {bucket: items}].
    open_: dict[int, list[list]] = {capacity: []}
    done: list[list] = []
    for b in range(len(bounds) - 1, -1, -1):
        size, left = int(bounds[b]), int(amount[b])
        while left:
            room = min((r for r, kinds in open_.items() if r >= size and kinds), default=None)
            if room is None:
                per = min(left, capacity // size)
                made = left // per
                kind, room_after = [made, {b: per}], capacity - per * size
                open_.setdefault(room_after, []).append(kind)
                left -= made * per
                continue
            kind = open_[room].pop()
            per = min(left, room // size)
            used = min(kind[0], left // per)
            if used < kind[0]:
                open_[room].append([kind[0] - used, dict(kind[1])])
            kind[0] = used
            kind[1][b] = kind[1].get(b, 0) + per
            open_.setdefault(room - per * size, []).append(kind)
            left -= used * per
    done = [k for kinds in open_.values() for k in kinds]
    runs, at, first = [], dict.fromkeys(range(len(bounds)), 0), 0
    for how_many, items in done:
        for b, each in items.items():
            runs.append((b, at[b], first, each))
            at[b] += how_many * each
        first += how_many
    runs.sort()
    columns = [np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 4
    return Plan(bounds, *columns, containers=first)


def containers(sizes: DataFrame, key: str, size: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(key, part, first, size, container): every item, or part of one, with its container.

    ``first`` is where the part begins in its item. ``sizes`` is read more than once and should be cheap, or is cut off
    here: its two columns are checkpointed in the shared folder.
    """
    sizes = shared_checkpoint(sizes.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    cap = F.lit(capacity).cast("long")
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))
    parts = sizes.select("item", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).select(
        "item", "part", (F.col("part") * cap).alias("first"), F.least(cap, F.col("n") - F.col("part") * cap).alias("size")
    )
    histogram = parts.groupBy("size").count().toPandas()  # at most capacity + 1 rows
    some = histogram[histogram["size"] > 0]
    made = plan(some["size"].to_numpy(), some["count"].to_numpy(), capacity, buckets)
    shards = max(1, -(-int(histogram["count"].sum()) // SHARD_ROWS)) if len(histogram) else 1
    bounds, n_containers = made.bounds, max(1, made.containers)

    @F.pandas_udf("long")
    def bucket_of(size: pd.Series) -> pd.Series:
        return pd.Series(np.where(size > 0, np.searchsorted(bounds, size), -1))

    @F.pandas_udf("long")
    def container_of(bucket: pd.Series, number: pd.Series) -> pd.Series:
        b, i = bucket.to_numpy(), number.to_numpy()
        out = i % n_containers
        full = b >= 0
        out[full] = made.place(b[full], i[full])
        return pd.Series(out)

    items = parts.withColumn("bucket", bucket_of("size")).withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards)))
    ranked = items.withColumn(
        "rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("item", "part", "size")) - 1
    )
    before = F.coalesce(F.sum("m").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = items.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("m")).withColumn("offset", before).drop("m")
    return (
        ranked.join(offsets, ["bucket", "shard"])
        .withColumn("container", container_of("bucket", (F.col("rank") + F.col("offset")).cast("long")))
        .select(F.col("item").alias(key), "part", "first", "size", "container")
    )
