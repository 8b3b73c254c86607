"""Attributes as known at event time, from path-copied persistent search trees.

Facts say: from ``valid`` on, an entity has these attributes, and this was known from ``known`` on. A tree holds facts
by (entity, valid). Inserting a fact copies the path to it and leaves all older nodes as they are, so each known time
has its own root and every earlier state of knowledge stays readable. An event picks the root of the latest known
time not after it, then finds the entity's last valid time not after it; what became known later isn't reachable
from that root.

Trees are numpy arrays of nodes, and a batch of events descends together, one array step per level.

Two routes with the same result: facts counted at no more than ``max_facts`` are built into one tree that is sent to
all executors, built once, and events aren't shuffled; above that, facts and events are shuffled by entity, each task builds
the tree of one shard at a time and streams its events past it, and entities with over ``HOT_SHARE`` of the events are
salted, with their facts repeated per salt. An entity with more facts than a shard should hold is cut into slices of time: a
fact belongs to the slice in which it can first hold (the later of its valid and known time), an event to that of its time, and of all
earlier slices one fact is carried in, the latest valid, as only that one can still hold.

Nulls: events without time or entity, and events before any fact, get null attributes; facts without entity, valid or
known time are no facts. Ties: of facts with equal entity, valid and known time the one greatest by its attributes
holds; one known later replaces one known earlier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.skew import heavy_keys
from tidelog.session import small_side, within

MAX_FACTS = 50_000
#: Facts of a shard, on average.
SHARD_FACTS = 10_000
#: Slices of an entity with many facts at most, and bounds of slices that are broadcast at most.
MAX_SLICES, MOST_BOUNDS = 512, 5_000_000
HOT_SHARE = 0.001
#: Generation starts up to here are broadcast, two numbers each; more are joined by hash.
MAX_STARTS = 1_000_000
SALTS = 64


class PersistentTree:
    """A treap of (entity, valid) keys with one root per known time; nodes are never changed once made."""

    def __init__(self, entity: np.ndarray, valid: np.ndarray, known: np.ndarray) -> None:
        """Facts as int arrays; the value of a node is the fact's position. Later positions win ties."""
        self._entity: list[int] = []
        self._valid: list[int] = []
        self._fact: list[int] = []
        self._left: list[int] = []
        self._right: list[int] = []
        self._priority: list[int] = []
        times: list[int] = []
        roots: list[int] = []
        root = -1
        for i in np.argsort(known, kind="stable").tolist():
            root = self._put(root, int(entity[i]), int(valid[i]), i)
            if times and times[-1] == known[i]:
                roots[-1] = root
            else:
                times.append(int(known[i]))
                roots.append(root)
        self.times = np.array(times, dtype=np.int64)
        self.roots = np.array(roots, dtype=np.int64)
        self.entity, self.valid, self.fact, self.left, self.right = (
            np.array(x, dtype=np.int64) for x in (self._entity, self._valid, self._fact, self._left, self._right)
        )
        # Only the arrays are needed from here on, here and where the tree is sent.
        del self._entity, self._valid, self._fact, self._left, self._right, self._priority

    def _node(self, entity: int, valid: int, fact: int, left: int, right: int, priority: int) -> int:
        for column, x in zip(
            (self._entity, self._valid, self._fact, self._left, self._right, self._priority),
            (entity, valid, fact, left, right, priority),
            strict=True,
        ):
            column.append(x)
        return len(self._entity) - 1

    def _copy(self, n: int, left: int, right: int) -> int:
        return self._node(self._entity[n], self._valid[n], self._fact[n], left, right, self._priority[n])

    def _split(self, n: int, key: tuple[int, int]) -> tuple[int, int]:
        """The nodes below ``key`` and those above it; the key itself is in neither."""
        if n < 0:
            return -1, -1
        here = (self._entity[n], self._valid[n])
        if here == key:
            return self._left[n], self._right[n]
        if here < key:
            a, b = self._split(self._right[n], key)
            return self._copy(n, self._left[n], a), b
        a, b = self._split(self._left[n], key)
        return a, self._copy(n, b, self._right[n])

    def _put(self, root: int, entity: int, valid: int, fact: int) -> int:
        # The priority is a mix of the key's bits, so the shape depends on the keys alone.
        p = (entity * 0x9E3779B97F4A7C15 ^ valid * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)
        p = ((p ^ p >> 29) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        p ^= p >> 32
        key, path, n = (entity, valid), [], root
        while n >= 0 and (self._priority[n], self._entity[n], self._valid[n]) > (p, entity, valid):
            here = (self._entity[n], self._valid[n])
            path.append((n, key > here))
            n = self._right[n] if key > here else self._left[n]
        if n >= 0 and (self._entity[n], self._valid[n]) == key:
            new = self._node(entity, valid, fact, self._left[n], self._right[n], p)
        else:
            a, b = self._split(n, key)
            new = self._node(entity, valid, fact, a, b, p)
        for n, right in reversed(path):
            new = self._copy(n, self._left[n], new) if right else self._copy(n, new, self._right[n])
        return new

    def find(self, entity: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Per event the position of its fact, -1 if there is none. Entities below 0 have none."""
        best = np.full(len(entity), -1, dtype=np.int64)
        if not len(self.times) or not len(entity):
            return best
        version = np.searchsorted(self.times, time, side="right") - 1
        node = np.where((version >= 0) & (entity >= 0), self.roots[np.maximum(version, 0)], -1)
        while (live := node >= 0).any():
            at = np.where(live, node, 0)
            e = self.entity[at]
            low = live & ((e < entity) | ((e == entity) & (self.valid[at] <= time)))
            best = np.where(low, at, best)
            node = np.where(live, np.where(low, self.right[at], self.left[at]), -1)
        found = (best >= 0) & (self.entity[np.maximum(best, 0)] == entity)
        return np.where(found, self.fact[np.maximum(best, 0)], -1)


class _Index:
    """A tree with the dictionary of its entities and the attributes of its facts."""

    def __init__(self, facts: pa.Table) -> None:
        self.attributes = facts.drop_columns(["entity", "valid", "known"])
        codes = facts["entity"].combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        self.entities = codes.dictionary
        self.tree = PersistentTree(
            codes.indices.to_numpy(zero_copy_only=False),
            facts["valid"].to_numpy(),
            facts["known"].to_numpy(),
        )

    def attach(self, events: pa.Table, entity: str, time: str) -> pa.Table:
        codes = pc.index_in(events[entity], value_set=self.entities)
        usable = pc.and_(pc.is_valid(codes), pc.is_valid(events[time]))
        e = pc.if_else(usable, pc.fill_null(codes, -1).cast(pa.int64()), -1).to_numpy()
        t = pc.fill_null(events[time], 0).to_numpy()
        found = self.tree.find(e, t)
        take = pa.array(found, mask=found < 0)
        for name in self.attributes.column_names:
            events = events.append_column(name, self.attributes[name].take(take))
        return events


def as_known(
    events: DataFrame,
    entity: str,
    time: str,
    facts: DataFrame,
    attributes: Sequence[str],
    max_facts: int = MAX_FACTS,
) -> DataFrame:
    """``events`` with the ``attributes`` of ``facts`` as they were known at each event's ``time``.

    ``facts`` has columns entity, valid, known (longs of the same unit as ``time``) and ``attributes``, whose names must
    not be among those of ``events``.
    """
    clash = {a.lower() for a in attributes} & {c.lower() for c in events.columns}
    if clash:
        raise ValueError(f"events already have columns {sorted(clash)}")
    facts = facts.select("entity", "valid", "known", *attributes).dropna(subset=["entity", "valid", "known"])
    # Within one (entity, valid, known) only the fact that wins stays.
    packed = F.struct(*attributes)
    facts = facts.groupBy("entity", "valid", "known").agg(F.max(packed).alias("a")).select("entity", "valid", "known", "a.*")
    out = T.StructType([*events.schema.fields, *[facts.schema[a] for a in attributes]])
    names = out.fieldNames()
    if within(facts, max_facts):
        # Built here, sent as arrays, and unpacked once per Python worker.
        sent = events.sparkSession.sparkContext.broadcast(_Index(facts.toArrow()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                yield from index.attach(pa.Table.from_batches([b]), entity, time).select(names).to_batches()

        return events.mapInArrow(search, out)
    return _sharded(events, entity, time, facts, attributes, out)


def _sharded(
    events: DataFrame, entity: str, time: str, facts: DataFrame, attributes: Sequence[str], out: T.StructType
) -> DataFrame:
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = facts.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    n_facts, most = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    slices = min(MAX_SLICES, max(1, -(-most // SHARD_FACTS)))
    cuts = _cuts(facts, per, slices)
    hot = heavy_keys(events, entity, HOT_SHARE).select(F.col(entity).alias("hot_entity"))
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    # Where an entity's facts are cut into slices of time, its events are spread already.
    salts = F.when(F.col("hot_entity").isNull(), F.lit(1)).when(F.col("bounds").isNull(), F.lit(SALTS)).otherwise(F.lit(max(1, SALTS // slices)))
    e = events.select(F.struct(*[f"`{c}`" for c in events.columns]).alias("e"), F.col(f"`{entity}`").alias("shard_entity"), F.col(f"`{time}`").alias("at"))
    e = _sliced(e, cuts).join(hot, F.col("shard_entity") == F.col("hot_entity"), "left")
    e = e.select("shard_entity", "slice", F.pmod(F.xxhash64("at"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "e")
    f = facts.select(F.struct("entity", "valid", "known", *attributes).alias("f"), F.col("entity").alias("shard_entity"), F.greatest("valid", "known").alias("at"))
    f = _sliced(f, cuts)
    if slices > 1:
        f = f.unionByName(_carried(f, cuts, slices))
    f = f.join(hot, F.col("shard_entity") == F.col("hot_entity"), "left")
    f = f.select("shard_entity", "slice", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "f")
    both = f.unionByName(e, allowMissingColumns=True)
    shards = max(16 * n, -(-2 * n_facts // SHARD_FACTS))
    shard = F.pmod(F.xxhash64("shard_entity", "slice", "salt"), F.lit(shards)).alias("shard")
    both = both.select(shard, "kind", "e", "f").repartition(min(shards, 8 * n), "shard").sortWithinPartitions("shard", "kind")
    names = out.fieldNames()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, waiting = None, None, []
        for b in batches:
            shards, kinds = b["shard"].to_numpy(), b["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = pa.Table.from_batches([b.slice(lo, hi - lo)])
                if shards[lo] != at:
                    at, index, waiting = shards[lo], None, []
                if kinds[lo] == 0:
                    waiting.append(_unpack(part["f"]))
                    continue
                if index is None:
                    empty = _unpack(part["f"]).slice(0, 0)
                    index = _Index(pa.concat_tables(waiting or [empty]))
                    waiting = []
                yield from index.attach(_unpack(part["e"]), entity, time).select(names).to_batches()

    return both.mapInArrow(stream, out)


def _cuts(facts: DataFrame, per: DataFrame, slices: int) -> DataFrame:
    """(cut_entity, bounds): of each entity with more than ``SHARD_FACTS`` facts, the times that cut these into about equal slices.
    Any bounds give the same result; few entities have so many facts, and their bounds are broadcast if counted small."""
    large = per.where(F.col("n") > (SHARD_FACTS if slices > 1 else 2**62)).select(F.col("entity").alias("cut_entity"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)] or [F.lit(0.5)])
    seen = facts.join(large, F.col("entity") == F.col("cut_entity"), "left_semi")
    bounds = seen.groupBy(F.col("entity").alias("cut_entity")).agg(F.percentile_approx(F.greatest("valid", "known"), shares, 10_000).alias("bounds"))
    return small_side(bounds, MOST_BOUNDS // slices)


def _sliced(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (shard_entity, at, ...) with ``bounds`` and ``slice``, how many of them ``at`` has passed."""
    joined = rows.join(cuts, F.col("shard_entity") == F.col("cut_entity"), "left").drop("cut_entity")
    passed = F.size(F.filter("bounds", lambda b: b <= F.col("at")))
    return joined.withColumn("slice", F.when(F.col("bounds").isNull() | F.col("at").isNull(), 0).otherwise(passed))


def _carried(f: DataFrame, cuts: DataFrame, slices: int) -> DataFrame:
    """For each slice of a cut entity the one fact of all earlier slices that can still hold: the latest valid, then known."""
    best = f.where("bounds is not null").groupBy("shard_entity", "slice").agg(F.max(F.struct("f.valid", "f.known", "f")).alias("b"))
    every = cuts.select(F.col("cut_entity").alias("every_entity"), "bounds", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("every_slice"))
    joined = every.join(best, (F.col("every_entity") == F.col("shard_entity")) & (F.col("every_slice") == F.col("slice")), "left")
    # One row per slice.
    before = Window.partitionBy("every_entity").orderBy("every_slice").rowsBetween(Window.unboundedPreceding, -1)
    kept = joined.select("every_entity", "every_slice", "bounds", F.max("b").over(before).alias("b")).where("b is not null")
    return kept.select("b.f", F.col("every_entity").alias("shard_entity"), F.greatest("b.f.valid", "b.f.known").alias("at"), "bounds", F.col("every_slice").alias("slice"))


def _unpack(column: pa.ChunkedArray) -> pa.Table:
    return pa.Table.from_struct_array(column.combine_chunks())


def membership_facts(generations: DataFrame, time_us) -> DataFrame:
    """(entity, valid, known, listed) facts: a stream enters with the first generation that lists it, and leaves with the
    next that doesn't. ``generations`` has ``streams``; ``time_us`` is its start. Rows without a start are no generation;
    rows of equal start are one generation with the streams of all of them.
    """
    rows = generations.select(time_us.alias("start"), "streams").where("start is not null")
    # The list of generations is as long as the topology's history; numbering it needs no partitioning.
    starts = rows.select("start").distinct().withColumn("i", F.row_number().over(Window.orderBy("start")))
    members = rows.select("start", F.explode("streams").alias("entity")).where("entity is not null").distinct()
    starts = small_side(starts, MAX_STARTS)
    members = members.join(starts, "start").select("entity", "i", "start")
    was = members.select("entity", (F.col("i") + 1).alias("i"))
    enter = members.join(was, ["entity", "i"], "left_anti").select("entity", "start", F.lit(True).alias("listed"))
    gone = was.join(members.select("entity", "i"), ["entity", "i"], "left_anti")
    leave = gone.join(starts, "i").select("entity", "start", F.lit(False).alias("listed"))
    return enter.unionByName(leave).select("entity", F.col("start").alias("valid"), F.col("start").alias("known"), "listed")
