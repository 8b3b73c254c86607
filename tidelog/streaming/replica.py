"""A replica of one table, kept up to date from its change log.

The state is what the fold needs: row states with their tombstones, deletions of partitions and of ranges, and the cells and
clearings of each collection. Each is a maximum, so a batch that comes again, or late, or under a number used before changes
nothing that it shouldn't, and no batch is ever skipped. A batch is written as a part beside those that are there; readers
merge the parts. Once there are more than ``MOST_PARTS`` they are merged into one. A pointer file names the parts of a version; it
is renamed into place, so a failure leaves the version before. Parts that neither of the last two versions names are deleted.

Modes: *delta* applies operations 1 to 8. *postimage* applies 3 to 8, and of inserts and updates the postimage row that follows
in the same batch of writes, as a whole row; without one they change nothing. *preimage* is delta, and compares each
preimage row (operation 0) with the replica's row just before it: with all earlier changes of its row and deletions of its
partition, and with the range deletes of earlier batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.collection import list_values
from tidelog.model import Mode, TableSpec
from tidelog.operators import decode, elements, fold, ordered, preimage
from tidelog.operators.stabbing import cover_max
from tidelog.session import fresh
from tidelog.sources.manifest import _fs

MOST_PARTS = 8


class Replica:
    """The state of the table ``spec`` under ``folder``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, spec: TableSpec, mode: Mode = Mode.DELTA) -> None:
        self.spark, self.folder, self.spec, self.mode = spark, folder, spec, mode
        self.pk, self.ck, self.key = list(spec.partition_key), list(spec.clustering_key), list(spec.primary_key)

    # Versions

    def version(self) -> int | None:
        fs, root, _ = _fs(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n.removeprefix("current-")) for n in names if n.startswith("current-")), default=None)

    def _parts(self, version: int | None) -> list[str]:
        fs, _, path = _fs(self.spark, self.folder)
        at = path(f"{self.folder}/current-{version}")
        if version is None or not fs.exists(at):
            return []
        return json.loads(self.spark.read.text(at.toString()).first()[0])

    def _commit(self, version: int, parts: list[str]) -> None:
        fs, root, path = _fs(self.spark, self.folder)
        waiting = path(f"{self.folder}/_waiting-{uuid.uuid4().hex}")
        out = fs.create(waiting, True)
        out.write(json.dumps(parts).encode())
        out.close()
        if not fs.rename(waiting, path(f"{self.folder}/current-{version}")):
            raise RuntimeError(f"version {version} couldn't be committed")
        kept = {*parts, *self._parts(version - 1)}
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("part-") and name not in kept or name.startswith("current-") and int(name.removeprefix("current-")) < version - 1:
                fs.delete(s.getPath(), True)

    # State

    def _folds(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        """How several parts of each kind are one."""

        def most(*by: str, **kept: str) -> Callable[[DataFrame], DataFrame]:
            return lambda df: df.groupBy(*by).agg(*[F.max(c).alias(c) for c in kept])

        rows = dict.fromkeys(("mark", "row_deleted_us", *self.spec.scalars), "")
        out = {"rows": most(*self.key, **rows), "partitions": most(*self.pk, partition_deleted_us="")}
        if self.spec.ranges:
            out["ranges"] = most(*self.pk, "lo", "hi", us="")
        for c, _ in self.spec.collections:
            out[f"cells_{c}"] = most(*self.key, "elem", w="")
            out[f"cleared_{c}"] = most(*self.key, cleared_us="")
        return out

    def _stored(self, parts: list[str], kind: str) -> DataFrame | None:
        found = [f"{self.folder}/{p}/{kind}" for p in parts]
        return self._folds()[kind](self.spark.read.parquet(*found)) if found else None

    def _state_of(self, changes: DataFrame) -> dict[str, DataFrame]:
        known = changes.where(F.col("us").isNotNull() & F.col(f"`{self.pk[0]}`").isNotNull())
        out = {"rows": fold.row_states(changes, self.pk, self.ck, self.spec.scalars), "partitions": fold.partition_tombstones(changes, self.pk)}
        if self.spec.ranges:
            out["ranges"] = fold.range_tombstones(changes, self.pk, self.ck)
        for c, kind in self.spec.collections:
            writes = known.where("op in (1, 2)")
            cells = elements.element_cells(writes, self.key, c, kind, ["expire_us"], text=False)
            out[f"cells_{c}"] = cells.select(*self.key, "elem", F.struct("us", "gone", "value", "expire_us").alias("w"))
            cleared = writes.where(decode.is_deleted(c)).select(*self.key, (F.col("us") - 1).alias("cleared_us"))
            out[f"cleared_{c}"] = cleared
        return {k: self._folds()[k](v) for k, v in out.items()}

    # Changes

    def _routed(self, log: DataFrame) -> DataFrame:
        """The batch decoded, with what this mode applies as operations 1 to 8, and preimages as 0."""
        changes = decode.checked(fold.decoded(log, [*self.key, *self.spec.columns]), self.mode)
        if self.mode is not Mode.POSTIMAGE:
            return changes
        own = changes.columns
        copies = changes.dropDuplicates(["stream_id", "change_time", "seq"])
        images = ordered.postimages(copies, ["stream_id", "change_time"], ["seq"])
        whole = {"op": F.col("applied_op"), **{f"cdc$deleted_{c}": F.lit(True) for c in self.spec.columns}}
        return changes.where("op between 3 and 8").unionByName(images.withColumns(whole).select(*own))

    def apply(self, changes: DataFrame, batch_id: int | None = None) -> None:
        """Fold a batch of the log into the replica; the callback of ``CdcEngine.fetch_changes``. ``batch_id`` isn't needed."""
        version = self.version()
        parts, routed = self._parts(version), self._routed(changes)
        part = f"part-{uuid.uuid4().hex}"
        for kind, df in self._state_of(routed).items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{part}/{kind}")
        if self.mode is Mode.PREIMAGE:
            self._checked(routed, parts).write.mode("append").parquet(f"{self.folder}/mismatches")
        parts = [*parts, part]
        if len(parts) > MOST_PARTS:
            whole = f"part-{uuid.uuid4().hex}"
            for kind in self._folds():
                self._stored(parts, kind).write.mode("overwrite").parquet(f"{self.folder}/{whole}/{kind}")
            parts = [whole]
        self._commit((version or 0) + 1, parts)

    # Reading

    def _deleted(self, states: DataFrame, parts: list[str]) -> DataFrame:
        """``states`` with ``deleted_us``, the latest deletion that covers the row."""
        states = fold.with_partition_tombstones(states, self._stored(parts, "partitions"), self.pk, self.ck or self.pk)
        deleted = ["row_deleted_us", "partition_deleted_us"]
        if self.spec.ranges:
            states = cover_max(states, self._stored(parts, "ranges"), "range_deleted_us", self.pk, self.ck)
            deleted.append("range_deleted_us")
        return states.withColumn("deleted_us", F.greatest(*deleted))

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        same = F.lit(True)
        for c in self.key:
            same = same & a[f"`{c}`"].eqNullSafe(b[f"`{c}`"])
        return same

    def rows(self, now_us: int) -> DataFrame:
        """The rows that exist at ``now_us``: states of the columns, the change that supplied each in ``<column>_time``, and
        collections as arrays (sets and lists) or maps, null where empty."""
        parts = self._parts(self.version())
        if not parts:
            raise ValueError("the replica is empty")
        states = self._deleted(self._stored(parts, "rows"), parts)
        for c, kind in self.spec.collections:
            states = self._with_collection(states, parts, c, kind, now_us)
        some = None
        for c, _ in self.spec.collections:
            some = F.col(f"`{c}`").isNotNull() if some is None else some | F.col(f"`{c}`").isNotNull()
        return fold.live_rows(states, self.spec.scalars, now_us, some)

    def _with_collection(self, states: DataFrame, parts: list[str], column: str, kind: str, now_us: int) -> DataFrame:
        cells, cleared = self._stored(parts, f"cells_{column}"), self._stored(parts, f"cleared_{column}")
        joined = cells.join(cleared, self._same_key(cells, cleared), "left").select(*[cells[f"`{c}`"] for c in self.key], "elem", "w", "cleared_us")
        dead = states.select(*[F.col(f"`{c}`") for c in self.key], "deleted_us")
        live = joined.join(dead, self._same_key(joined, dead), "left").where(
            "w.gone = 0 and (cleared_us is null or w.us > cleared_us) and (deleted_us is null or w.us > deleted_us)"
        ).where(F.col("w.expire_us") > now_us)
        pairs = F.map_from_entries(F.collect_list(F.struct("elem", F.col("w.value").alias("value"))))
        made = {"set": F.array_sort(F.collect_list("elem")), "map": pairs, "list": list_values(pairs)}[kind]
        # One row's collection is small: the database keeps it so.
        whole = live.groupBy(*[joined[f"`{c}`"] for c in self.key]).agg(made.alias(column))
        return states.join(whole, self._same_key(states, whole), "left").select(*[states[f"`{c}`"] for c in states.columns], whole[f"`{column}`"])

    # Preimages

    def _checked(self, changes: DataFrame, parts: list[str]) -> DataFrame:
        """(key, change_time, mismatch, expected, found) of the preimages that differ from the row just before them."""
        scalars = self.spec.scalars
        # Each change by itself, and the stored states as if changed at the beginning of time.
        times = changes.where("op in (1, 2, 3)").select(F.col("us").alias("at"), "*")
        cells = {"mark": F.when(F.col("op") == 2, F.struct("us", "expire_us")), "row_deleted_us": F.when(F.col("op") == 3, F.col("us")), **{c: fold._cell(c) for c in scalars}}
        names = [*cells]
        events = times.select(*self.key, "at", F.lit(1).alias("kind"), *[v.alias(f"s_{k}") for k, v in cells.items()])
        pre = changes.where(F.col("op") == 0).dropDuplicates([*self.key, "change_time"])
        pre = pre.select(*self.key, F.col("us").alias("at"), F.lit(0).alias("kind"), "change_time", *[F.col(f"`{c}`").alias(f"pre_{c}") for c in scalars])
        everything = events.unionByName(pre, allowMissingColumns=True)
        if parts:
            stored = self._deleted(self._stored(parts, "rows"), parts)
            stored = stored.withColumn("row_deleted_us", F.col("deleted_us")).select(*self.key, F.lit(fold.LOWEST).alias("at"), F.lit(1).alias("kind"), *[F.col(f"`{k}`").alias(f"s_{k}") for k in names])
            touched = pre.select(*self.key).distinct()
            everything = everything.unionByName(stored.join(touched, self._same_key(stored, touched), "left_semi"), allowMissingColumns=True)
        # The changes of one row within one batch, and of one partition its deletions only.
        w = Window.partitionBy(*self.key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
        before = everything.withColumns({f"s_{k}": F.max(f"s_{k}").over(w) for k in names}).where("kind = 0")
        number = fresh("preimage_no", before)
        before = before.withColumn(number, F.xxhash64(*self.key, "change_time"))
        drops = changes.where("op = 4").select(*self.pk, F.col("us").alias("at"), F.col("us").alias("dropped"))
        pw = Window.partitionBy(*self.pk).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
        seen = before.select(*self.pk, "at", number).unionByName(drops, allowMissingColumns=True)
        seen = seen.withColumn("dropped", F.max("dropped").over(pw)).where(F.col(number).isNotNull()).select(number, "dropped")
        before = before.join(seen.groupBy(number).agg(F.max("dropped").alias("dropped")), number, "left")
        dead = F.coalesce(F.greatest("s_row_deleted_us", "dropped"), F.lit(fold.LOWEST))

        def live(c: str) -> Column:
            cell = F.col(f"s_{c}")
            return cell.isNotNull() & (cell["us"] > dead) & (cell["expire_us"] > F.col("at"))

        exists, pairs = live("mark"), []
        for c in scalars:
            has = live(c) & ~F.col(f"s_{c}.gone")
            exists = exists | has
            pairs.append((c, F.when(has, F.col(f"s_{c}.value")), F.col(f"pre_{c}")))
        exists = F.coalesce(exists, F.lit(False))
        found = before.select(*self.key, "change_time", preimage.first_mismatch(pairs, exists).alias("d"))
        return found.where("d is not null").select(*self.key, "change_time", "d.mismatch", "d.expected", "d.found")

    def mismatches(self) -> DataFrame:
        """The preimages that differed; a batch that came again reports its own again, so each is listed once."""
        return self.spark.read.parquet(f"{self.folder}/mismatches").distinct()
