"""One query per operator of the change-data engine, over whole tables.

The logs of TESTDATA are used where they have what an operator needs. They have no preimages, postimages or collections;
for these a log is derived from ``events`` with integer arithmetic: stream = pk = user_id, op = (event_id * 7919 + user_id)
% 10, ck = the integer in props, ordered by (ts, event_id).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import collection
from tidelog.functions import timeuuid as tu
from tidelog.model import MULTI_CK, SCALAR, Mode, TableSpec
from tidelog.operators import decode, elements, fold, generations, ordered, preimage, topology, vnodes, windows
from tidelog.operators.changes import key_columns
from tidelog.plans.problems import P5_NOW_US
from tidelog.plans.tables import multi_log, scalar_log, table
from tidelog.session import shared_folder
from tidelog.streaming.engine import CdcEngine
from tidelog.streaming.replica import Replica

#: 2026-01-20, 2026-01-21 and 2026-01-25 00:00 UTC in ms.
FROM_MS, TO_MS, REPLAY_TO_MS = 1_768_867_200_000, 1_768_953_600_000, 1_769_299_200_000
ORIGIN_MS = 1_767_225_600_000
HOUR_MS = 3_600_000
#: 2026-02-01: a task has few streams, so its window is longer.
TASK_TO_MS = 1_769_904_000_000
#: 2026-02-20: after all changes.
CLOCK_MS = 1_771_545_600_000


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cdc_streams_descriptions")


def gen_starts(spark, sf_dir):
    return generations.starts(_generations(spark, sf_dir))


def gen_list(spark, sf_dir):
    return generations.generations_of(_generations(spark, sf_dir), now_us=FROM_MS * 1000)


def gen_next(spark, sf_dir):
    return generations.next_generation(_generations(spark, sf_dir), FROM_MS * 1000)


def gen_end(spark, sf_dir):
    return generations.generation_end(_generations(spark, sf_dir), FROM_MS * 1000)


def gen_streams(spark, sf_dir):
    return generations.streams_of(_generations(spark, sf_dir)).withColumn("stream_id", F.hex("stream_id"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vnodes.stream_vnodes(table(spark, sf_dir, "cdc_stream_tokens"), table(spark, sf_dir, "token_ring"))


def stream_vnodes(spark, sf_dir):
    return _assigned(spark, sf_dir).withColumn("stream_id", F.hex("stream_id"))


def vnode_tasks(spark, sf_dir):
    return vnodes.tasks(_assigned(spark, sf_dir)).drop("streams")


def window_scan(spark, sf_dir):
    rows = windows.scan(scalar_log(spark, sf_dir), FROM_MS, TO_MS)
    return rows.select(*key_columns(), tu.ticks(F.col("cdc$time")).alias("ticks"), "delivery_batch")


def task_scan(spark, sf_dir):
    """The changes that the busiest task of the log has in the window."""
    log, assigned = scalar_log(spark, sf_dir), _assigned(spark, sf_dir)
    per_stream = log.groupBy(F.col("cdc$stream_id").alias("stream_id")).agg(F.count(F.lit(1)).alias("n"))
    busiest = assigned.join(per_stream, "stream_id").groupBy("vnode_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "vnode_token").limit(1)
    streams = assigned.where(F.col("vnode_token") == busiest.select("vnode_token").scalar())
    return windows.scan(log, FROM_MS, TASK_TO_MS, streams).select(*key_columns(), "pk", "delivery_batch")


def task_scan_all(spark, sf_dir):
    """The changes of every task from the epoch to after the end of the log."""
    tasks = _assigned(spark, sf_dir).select("stream_id", "vnode_token", "wraparound").distinct()
    rows = windows.scan(scalar_log(spark, sf_dir), 0, CLOCK_MS)
    joined = rows.join(tasks, F.col("cdc$stream_id") == tasks["stream_id"]).drop(tasks["stream_id"])
    return joined.select(*key_columns(), "pk", "delivery_batch", "vnode_token", "wraparound")


def window_counts(spark, sf_dir):
    return windows.window_counts(scalar_log(spark, sf_dir), ORIGIN_MS)


def window_running_total(spark, sf_dir):
    return windows.running_total(windows.window_counts(scalar_log(spark, sf_dir), ORIGIN_MS, HOUR_MS))


def window_last_non_empty(spark, sf_dir):
    return windows.last_non_empty(windows.window_counts(scalar_log(spark, sf_dir), ORIGIN_MS))


def window_fetch(spark, sf_dir):
    """The next window of each generation when the clock shows ``FROM_MS``, from the generation's start."""
    ms = tu.floor_div(F.col("start_us"), 1000), tu.floor_div(F.col("end_us"), 1000)
    rows = generations.generations_of(_generations(spark, sf_dir)).select(ms[0].alias("gen_start_ms"), ms[1].alias("gen_end_ms"))
    w = windows.window_column(F.col("gen_start_ms"), F.col("gen_end_ms"), F.lit(FROM_MS))
    pace = windows.pace_column(F.col("w"), F.lit(False))
    return rows.withColumn("w", w).select("gen_start_ms", "w.start_ms", "w.end_ms", "w.cropped", "w.last", pace.alias("pace_ms"))


def time_functions(spark, sf_dir):
    u = F.col("cdc$time")
    ms = tu.millis(u)
    return scalar_log(spark, sf_dir).select(
        F.lower(u).alias("change_time"), tu.ticks(u).alias("ticks"), tu.micros(u).alias("us"), ms.alias("ms"),
        tu.first_tick(ms).alias("first_tick"), tu.last_tick(ms).alias("last_tick"),
    ).distinct()


def operation_counts(spark, sf_dir):
    rows = multi_log(spark, sf_dir).select(F.col("cdc$operation").cast("int").alias("op"))
    return decode.checked(rows, Mode.DELTA).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def operation_targets(spark, sf_dir):
    """What each change of multi_ck acts on, by the handler of its operation."""

    def named(kind: str, *columns: str) -> Column:
        return F.concat_ws("/", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])

    row, bound = ["pk", "c1", "c2"], named("bound", "pk", "c1", "c2")
    handlers = {1: named("cells", *row), 2: named("row", *row), 3: named("no row", *row), 4: named("no partition", "pk"), **dict.fromkeys((5, 6, 7, 8), bound)}
    return multi_log(spark, sf_dir).select(*key_columns(), decode.dispatch(F.col("cdc$operation"), handlers).alias("target")).distinct()


def row_keys(spark, sf_dir):
    return decode.primary_keys(multi_log(spark, sf_dir), MULTI_CK).distinct()


def base_rows(spark, sf_dir):
    """All columns but the log's own."""
    return decode.without_metadata(scalar_log(spark, sf_dir)).select("pk", "ck", "v", "s", "delivery_batch")


def cell_states(spark, sf_dir):
    return decode.cell_states(scalar_log(spark, sf_dir), key_columns(), SCALAR.columns).distinct()


def ttl_values(spark, sf_dir):
    return scalar_log(spark, sf_dir).select(*key_columns(), decode.ttl().alias("ttl")).where("ttl is not null").distinct()


def _upto(log: DataFrame, end_ms: int) -> DataFrame:
    return windows.scan(log, 0, end_ms)


def _values(columns: tuple[str, ...]) -> list[Column]:
    return [F.when(~F.col(f"{c}.gone"), F.col(f"{c}.value")).alias(c) for c in columns]


def _replayed(spark: SparkSession, sf_dir: str, end_ms: int) -> DataFrame:
    changes = fold.decoded(_upto(scalar_log(spark, sf_dir), end_ms), ["pk", "ck", "v", "s"]).where("op in (1, 2)")
    rows = fold.row_states(changes, ["pk"], ["ck"], ["v", "s"])
    us = F.greatest("v.us", "s.us", "mark.us")
    return rows.where(us.isNotNull()).select("pk", "ck", *_values(("v", "s")), us.alias("write_us"))


def replay_delta(spark, sf_dir):
    """Inserts and updates up to an instant, last write per cell; neither deletions of rows nor lifetimes are applied."""
    return _replayed(spark, sf_dir, REPLAY_TO_MS)


def replay_delta_all(spark, sf_dir):
    """``replay_delta`` up to an instant after the end of the log."""
    return _replayed(spark, sf_dir, CLOCK_MS)


def ttl_live_rows(spark, sf_dir):
    """v as it lives at p5's instant by lifetime alone."""
    changes = fold.decoded(scalar_log(spark, sf_dir), ["pk", "ck", "v"]).where("op in (1, 2)")
    rows = fold.row_states(changes, ["pk"], ["ck"], ["v"])
    return rows.where((~F.col("v.gone")) & (F.col("v.expire_us") > P5_NOW_US)).select("pk", "ck", *_values(("v",)))


def row_delete_apply(spark, sf_dir):
    changes = fold.decoded(scalar_log(spark, sf_dir), ["pk", "ck", "v"])
    rows = fold.row_states(changes, ["pk"], ["ck"], ["v"])
    return rows.where((~F.col("v.gone")) & (F.col("row_deleted_us").isNull() | (F.col("row_deleted_us") < F.col("v.us")))).select("pk", "ck", *_values(("v",)))


def partition_delete_apply(spark, sf_dir):
    changes = fold.decoded(scalar_log(spark, sf_dir), ["pk", "ck", "v"])
    rows = fold.row_states(changes, ["pk"], ["ck"], ["v"])
    rows = fold.with_partition_tombstones(rows, fold.partition_tombstones(changes, ["pk"]), ["pk"], ["ck"])
    dead = F.col("partition_deleted_us")
    return rows.where((~F.col("v.gone")) & (dead.isNull() | (dead < F.col("v.us")))).select("pk", "ck", *_values(("v",)))


def _range_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = fold.decoded(multi_log(spark, sf_dir), ["pk", "c1", "c2", "v"])
    return changes.dropDuplicates(["stream_id", "change_time", "seq"])


def range_delete_pairs(spark, sf_dir):
    pairs = ordered.range_pairs(_range_changes(spark, sf_dir), ["stream_id", "change_time"], ["seq"], ["seq", "c1", "c2"])
    return pairs.select(
        F.hex("stream_id").alias("stream_id"), "change_time", F.col("start.seq").alias("start_seq"), F.col("seq").alias("end_seq"), "pk",
        F.col("start.c1").alias("from_c1"), F.col("start.c2").alias("from_c2"), F.col("c1").alias("to_c1"), F.col("c2").alias("to_c2"),
        (F.col("start.op") == 5).alias("from_included"), (F.col("op") == 7).alias("to_included"),
    )


def range_orphans(spark, sf_dir):
    """Of the derived log, whose operations come in any order."""
    rows = ordered.range_orphans(_derived(spark, sf_dir), ["pk"], ["ts_us", "seq"], ordered.DAY_US)
    return rows.select("seq", "pk", "op")


def range_pairs_across_time(spark, sf_dir):
    rows = ordered.range_pairs(_derived(spark, sf_dir), ["pk"], ["ts_us", "seq"], ["seq", "ck"], ordered.DAY_US)
    return rows.select(F.col("seq").alias("end_seq"), F.col("start.seq").alias("start_seq"), "pk", F.col("start.ck").alias("from_ck"), F.col("ck").alias("to_ck"))


def range_delete_apply(spark, sf_dir):
    changes = fold.decoded(multi_log(spark, sf_dir), ["pk", "c1", "c2", "v"])
    rows = fold.row_states(changes, ["pk"], ["c1", "c2"], ["v"])
    rows = fold.cover_max(rows, fold.range_tombstones(changes, ["pk"], ["c1", "c2"]), "range_deleted_us", ["pk"], ["c1", "c2"], changes.count())
    dead = F.col("range_deleted_us")
    return rows.where((~F.col("v.gone")) & (dead.isNull() | (dead < F.col("v.us")))).select("pk", "c1", "c2", *_values(("v",)))


def lww_cells(spark, sf_dir):
    """The winning write of each cell in long form."""
    changes = fold.decoded(scalar_log(spark, sf_dir), ["pk", "ck", "v", "s"])
    rows = fold.row_states(changes, ["pk"], ["ck"], ["v", "s"])
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"{c}.us").alias("us"), F.col(f"{c}.gone").alias("gone"), F.col(f"{c}.change_time").alias("change_time")) for c in ("v", "s")])
    return rows.select("pk", "ck", F.explode(cells).alias("c")).where("c.us is not null").select("pk", "ck", "c.col", "c.us", "c.gone", "c.change_time")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), tu.epoch_us(e, "ts").alias("ts_us"), F.col("user_id").alias("pk"),
        F.expr("cast((event_id * 7919 + user_id) % 10 as int)").alias("op"),
        F.get_json_object("props", "$.k").cast("long").alias("ck"), F.col("value").alias("v"),
    )


def postimage_pairs(spark, sf_dir):
    rows = decode.checked(_derived(spark, sf_dir).where("op <> 0"), Mode.POSTIMAGE)
    return ordered.postimages(rows, ["pk"], ["ts_us", "seq"], ["seq"], ordered.DAY_US).select("seq", F.col("cause.seq").alias("prev_seq"), "applied_op")


def replay_postimage(spark, sf_dir):
    rows = ordered.postimages(_derived(spark, sf_dir).where("op <> 0"), ["pk"], ["ts_us", "seq"], slice_us=ordered.DAY_US)
    best = rows.groupBy("pk", "ck").agg(F.max(F.struct("ts_us", "v")).alias("b"))
    return best.select("pk", "ck", "b.v", F.col("b.ts_us").alias("write_us"))


def preimage_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    columns = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    pre = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.expr("case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end").alias("o_totalprice"),
                        F.expr("case when o_orderkey % 29 = 0 then null else o_orderpriority end").alias("o_orderpriority"))
    target = orders.where("o_orderkey % 17 <> 0").select("o_orderkey", *columns)
    return preimage.mismatches(pre, target, ["o_orderkey"], columns).select("o_orderkey", "mismatch")


def _collection_log(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Of the derived log, by event_id % 5: add, add, remove, add and remove, overwrite."""
    d = _derived(spark, sf_dir).where("ck is not null").withColumn("us", F.col("ts_us")).withColumn("m", F.col("seq") % 5)
    e = F.col("ck").cast("string") if kind == "map" else F.col("ck")
    if kind == "list":
        e = F.concat(F.lpad(F.lower(F.hex(F.col("ck"))), 8, "0"), F.lit("-0001-11f1-8080-808080808080"))
    added = F.array(e) if kind == "set" else F.create_map(e, F.col("seq"))
    return d.withColumns({
        "c": F.when(F.col("m") != 2, added),
        "cdc$deleted_elements_c": F.when(F.col("m").isin(2, 3), F.array(e)),
        "cdc$deleted_c": F.col("m") == 4,
    })


def _scalarised(live: DataFrame, pair: Column) -> DataFrame:
    return live.groupBy("pk").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("elements"))


def set_apply(spark, sf_dir):
    live = elements.current_elements(_collection_log(spark, sf_dir, "set"), ["pk"], "c", "set")
    return _scalarised(live, F.col("elem").cast("string"))


def map_apply(spark, sf_dir):
    live = elements.current_elements(_collection_log(spark, sf_dir, "map"), ["pk"], "c", "map")
    return _scalarised(live, F.concat_ws("=", "elem", "value"))


def list_apply(spark, sf_dir):
    live = elements.current_elements(_collection_log(spark, sf_dir, "list"), ["pk"], "c", "list")
    cells = live.groupBy("pk").agg(F.map_from_entries(F.collect_list(F.struct("elem", "value"))).alias("cells"))
    return cells.select("pk", F.array_join(collection.list_values(F.col("cells")), ",").alias("elements"))


def printer_lines(spark, sf_dir):
    return decode.printed(multi_log(spark, sf_dir))


def partition_key_rows(spark, sf_dir):
    return decode.partition_keys(multi_log(spark, sf_dir), MULTI_CK).distinct()


def _topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology events derived from ``events``: signups are joining nodes, errors leaving ones, the rest goes up or down."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "view", "up").otherwise("down")
    return e.select(F.col("user_id").alias("node"), tu.epoch_us(e, "ts").alias("us"), kind.alias("kind"))


def topology_changes(spark, sf_dir):
    return topology.topology_changes(_topology(spark, sf_dir)).select("node", "us", "kind")


def topology_last_change(spark, sf_dir):
    return topology.last_topology_change(_topology(spark, sf_dir))


def generations_to_refresh(spark, sf_dir):
    """Of each generation, fetched when it had settled, whether its end must be looked up again at the clock."""
    change = topology.last_topology_change(_topology(spark, sf_dir)).select(tu.floor_div(F.col("last_change_us"), 1000))
    rows_ms = scalar_log(spark, sf_dir).agg(F.max(tu.millis(F.col("cdc$time"))))
    fetched = tu.floor_div(F.col("start_us") + F.lit(generations.SETTLE_US), 1000)
    needed = topology.refresh_needed(fetched, F.col("end_us"), change.scalar(), rows_ms.scalar(), F.lit(CLOCK_MS))
    return generations.generations_of(_generations(spark, sf_dir)).select("start_us", "end_us", needed.alias("refresh"))


def _as_log(rows: DataFrame) -> DataFrame:
    """Rows (id, us, seq, op, pk, ck, v) as a change log: one stream per pk, one time per id."""
    return rows.select(
        F.unhex(F.lpad(F.hex("pk"), 32, "0")).alias("cdc$stream_id"), tu.uuid_at(F.col("us"), F.col("id")).alias("cdc$time"), F.col("seq").cast("int").alias("cdc$batch_seq_no"),
        F.col("op").cast("byte").alias("cdc$operation"), F.lit(None).cast("long").alias("cdc$ttl"), F.lit(None).cast("boolean").alias("cdc$deleted_v"), "pk", "ck", "v",
    )


def _replayed_by_parts(spark: SparkSession, log: DataFrame, spec: TableSpec, mode: Mode, part: Column, parts: int) -> Replica:
    """A replica after the batches ``part`` = 0, 1, ... of the log."""
    replica = Replica(spark, f"{shared_folder(spark)}/replica-{uuid.uuid4().hex}", spec, mode)
    for i in range(parts):
        replica.apply(log.where(part == i))
    return replica


def replica_multi(spark, sf_dir):
    """The replica of multi_ck after its log came in three batches, out of order; ranges included."""
    part = F.pmod(F.xxhash64(F.lower("cdc$time")), F.lit(3))
    return _replayed_by_parts(spark, multi_log(spark, sf_dir), MULTI_CK, Mode.DELTA, part, 3).rows(P5_NOW_US).select("pk", "c1", "c2", "v_time")


EVENTS_TABLE = TableSpec("events", ("pk",), ("ck",), ("v",))


def replica_postimage(spark, sf_dir):
    """The replica of a log derived from ``events`` in postimage mode: every eleventh event deletes its row, the others write it, and
    two of three are followed by a postimage, without a value in every seventh."""
    d = _derived(spark, sf_dir).where("ck is not null").withColumns({"id": F.col("seq"), "us": F.col("ts_us"), "seq": F.lit(0)})
    d = d.withColumn("op", F.expr("case when id % 11 = 0 then 3 else 1 + id % 2 end"))
    images = d.where("id % 3 <> 0").withColumns({"seq": F.lit(1), "op": F.lit(9), "v": F.expr("case when id % 7 <> 0 then v end")})
    log = _as_log(d.unionByName(images))
    part = F.pmod(F.xxhash64("cdc$time"), F.lit(2))
    rows = _replayed_by_parts(spark, log, EVENTS_TABLE, Mode.POSTIMAGE, part, 2).rows(P5_NOW_US)
    return rows.select("pk", "ck", F.when(F.col("v_time") != "", F.col("v.value")).alias("v"))


def replica_preimages(spark, sf_dir):
    """What preimage mode reports of a log derived from ``events``: each event of a row comes after a preimage, which is wrong in
    every thirteenth and empty in every seventeenth."""
    d = _derived(spark, sf_dir).where("ck is not null and v is not null").groupBy("pk", "ck", F.col("ts_us").alias("us")).agg(F.max(F.struct("seq", "v")).alias("e"))
    d = d.select("pk", "ck", "us", F.col("e.seq").alias("id"), "e.v").withColumn("was", F.lag("v").over(Window.partitionBy("pk", "ck").orderBy("us")))
    images = d.withColumn("v", F.expr("case when id % 13 = 0 then v + 1 when id % 17 <> 0 then was end")).withColumns({"seq": F.lit(0), "op": F.lit(0)})
    log = _as_log(d.withColumns({"seq": F.lit(1), "op": F.lit(2)}).unionByName(images))
    middle = F.lit(d.agg(F.percentile_approx("us", 0.5)).first()[0])
    part = (tu.micros(F.col("cdc$time")) > middle).cast("int")
    replica = _replayed_by_parts(spark, log, EVENTS_TABLE, Mode.PREIMAGE, part, 2)
    return replica.mismatches().select("pk", "ck", "change_time", "mismatch")


def stream_changes(spark, sf_dir):
    """The scalar log as the stream source delivers it: per generation and task, from the epoch to 10 s before a clock within it."""
    names = {"path": "scalar_scylla_cdc_log", "generations": "cdc_streams_descriptions", "ring": "token_ring", "tokens": "cdc_stream_tokens"}
    engine = CdcEngine(spark, **{k: f"{sf_dir}/{v}.parquet" for k, v in names.items()}, now_ms=REPLAY_TO_MS)
    return engine.read_once().select(*key_columns(), "pk", "ck", "delivery_batch")


QUERIES = {f.__name__: f for f in (
    gen_starts, gen_list, gen_next, gen_end, gen_streams, stream_vnodes, vnode_tasks, window_scan, task_scan, task_scan_all, window_counts,
    window_running_total, window_last_non_empty, window_fetch, time_functions, operation_counts, operation_targets, row_keys, base_rows, cell_states,
    ttl_values, replay_delta, replay_delta_all, ttl_live_rows, row_delete_apply, partition_delete_apply, range_delete_pairs, range_orphans,
    range_pairs_across_time, range_delete_apply, lww_cells, postimage_pairs, replay_postimage, preimage_check, set_apply, map_apply,
    list_apply, printer_lines, partition_key_rows, topology_changes, topology_last_change, generations_to_refresh, stream_changes,
    replica_multi, replica_postimage, replica_preimages,
)}
