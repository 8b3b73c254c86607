"""The source, keyed state, the replica and the manifest: batch and stream agree, and failures neither lose nor repeat."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_changes import machine
from tidelog.functions.timeuuid import EPOCH_TICKS, HOUR_US
from tidelog.model import MULTI_CK, SCALAR, Mode, TableSpec
from tidelog.operators import fold
from tidelog.operators.changes import KEYS, arrived_us, with_keys
from tidelog.plans.problems import P5_NOW_US
from tidelog.sources.cdclog import LogReader, ticks_of
from tidelog.sources.manifest import Incremental, listing, with_checksums
from tidelog.streaming.engine import CdcEngine
from tidelog.streaming.kslack import kslack
from tidelog.streaming.pairing import paired
from tidelog.streaming.replica import Replica


def paths(small):
    return {"log": f"{small}/scalar_scylla_cdc_log.parquet", "generations": f"{small}/cdc_streams_descriptions.parquet", "ring": f"{small}/token_ring.parquet", "tokens": f"{small}/cdc_stream_tokens.parquet"}


def test_source_reads_each_change_once(spark, small, tmp_path):
    """Four clocks on one checkpoint; changes of streams outside their generation aren't read, as no task has them."""
    got, p = [], paths(small)
    for now in (1_768_500_000_000, 1_768_500_000_000, 1_769_300_000_000, 1_772_000_000_000):
        engine = CdcEngine(spark, p["log"], p["generations"], p["ring"], p["tokens"], now_ms=now)
        q = engine.fetch_changes(lambda b, i: got.append(with_keys(b, F.col("delivery_batch")).toPandas()), str(tmp_path / "c"), once=True)
        q.awaitTermination()
    rows = [tuple(r) for g in got for r in g.itertuples(index=False)]
    from tidelog.plans.problems import p4_found

    wrong = {tuple(r) for r in p4_found(spark, small).collect()}
    log = [tuple(r) for r in with_keys(spark.read.parquet(p["log"]), F.col("delivery_batch")).collect()]
    assert sorted(rows) == sorted(r for r in log if r[:3] not in wrong)


def test_spans_tile_and_row_groups_are_dealt_once(spark, small, tmp_path):
    p = paths(small)
    r = LogReader({"path": p["log"], "now_ms": "100000"})
    assert r.latestOffset() == {"ms": 90_000} and r.initialOffset() == {"ms": 0}
    assert [(s.lo_ms, s.hi_ms) for s in r.spans({"ms": 5}, {"ms": 70_000})] == [(5, 70_000)] and r.partitions({"ms": 5}, {"ms": 5}) == []
    log = spark.read.parquet(p["log"])
    log.repartition(5).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "log"))
    r = LogReader({"path": str(tmp_path / "log"), "generations": p["generations"], "ring": p["ring"], "tokens": p["tokens"], "now_ms": "1771545600000", "most_pieces": "3"})
    spans = r.spans({"ms": 0}, r.latestOffset())
    assert all(a.hi_ms <= b.lo_ms for a, b in zip(spans, spans[1:])) and spans[-1].hi_ms == 1771545590000
    pieces = r.partitions({"ms": 0}, r.latestOffset())
    dealt = [(f, g) for x in pieces for f, groups in x.files for g in groups]
    assert len(pieces) == 3 and len(dealt) == len(set(dealt)) >= 5
    whole = sorted(str(x) for piece in pieces for b in r.read(piece) for x in b.select(["cdc$time", "delivery_batch"]).to_pylist())
    one = LogReader({**r.options, "most_pieces": "1"})
    assert whole == sorted(str(x) for piece in one.partitions({"ms": 0}, r.latestOffset()) for b in one.read(piece) for x in b.select(["cdc$time", "delivery_batch"]).to_pylist())


def test_young_generations_wait(small):
    p = paths(small)
    starts = sorted({int((t - type(t)(1970, 1, 1)).total_seconds() * 1000) for t in pq.read_table(p["generations"])["time"].to_pylist() if t})
    for s in starts:
        for wait, want in ((0, s - 10_001), (29_999, s - 1), (30_000, s + 20_000)):
            got = LogReader({"path": p["log"], "generations": p["generations"], "now_ms": str(s + wait)}).latestOffset()["ms"]
            others = [x - 1 for x in starts if s + wait - 30_000 < x]
            assert got == min([s + wait - 10_000, *others]) <= max(want, s + wait - 10_000)


def test_hex_times_in_arrays():
    import uuid

    ids = [str(uuid.UUID(int=i * 0x1234567890ABCDEF1234567 % 2**128)) for i in range(50)]
    ids = [x[:14] + "1" + x[15:] for x in ids] + ["8D780CCA-E9C9-11F0-805E-4955F9F11DCB"]
    assert ticks_of(pa.array(ids)).tolist() == [uuid.UUID(x).time - EPOCH_TICKS for x in ids]
    assert ticks_of(pa.array(["x", None, "g" * 36, "ä" * 18])).tolist() == [-(2**63)] * 4
    assert ticks_of(pa.array([], pa.string())).tolist() == []


def test_replica_is_the_batch_fold(spark, small, tmp_path):
    log = spark.read.parquet(paths(small)["log"])
    replica = Replica(spark, str(tmp_path / "r"), SCALAR)
    with pytest.raises(ValueError, match="empty"):
        replica.rows(0)
    parts = [log.where(f"delivery_batch % 3 = {i}") for i in range(3)]
    for i in (2, 0, 1):
        replica.apply(parts[i], (2, 0, 1).index(i))
        replica.apply(parts[i], (2, 0, 1).index(i))
    want = fold.current(log, SCALAR, P5_NOW_US).select("pk", "ck", "v_time", "s_time").collect()
    got = Replica(spark, str(tmp_path / "r"), SCALAR).rows(P5_NOW_US).select("pk", "ck", "v_time", "s_time").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_replica_of_collections_in_any_mode(spark, tmp_path):
    """A set, a map and a list beside a column: additions, removals, overwrites, lifetimes and deletions, in parts."""
    spec = TableSpec("t", ("pk",), ("ck",), ("v", "s", "m", "l"), (("s", "set"), ("m", "map"), ("l", "list")))
    from tests.test_fold import timeuuid

    kinds = {"s": "array<string>", "m": "map<string,int>", "l": "map<string,string>"}
    schema = "`cdc$stream_id` binary, `cdc$time` string, `cdc$batch_seq_no` int, `cdc$operation` byte, `cdc$ttl` long, pk int, ck int, v int, `cdc$deleted_v` boolean"
    for c, k in kinds.items():
        schema += f", {c} {k}, `cdc$deleted_{c}` boolean, `cdc$deleted_elements_{c}` array<string>"
    old, new = timeuuid(1, 1), timeuuid(2, 1)

    def row(us, op, ck, seq=0, ttl=None, v=None, s=(None, None, None), m=(None, None, None), ls=(None, None, None)):
        return (b"x", timeuuid(us, ck), seq, op, ttl, 1 + (ck == 5), ck, v, None, *s, *m, *ls)

    rows = [
        row(10, 1, 1, s=(["a", "b"], None, None), m=({"k": 1, "q": 2}, None, None), ls=({new: "2", old: "1"}, None, None)),
        row(20, 1, 1, s=(["c"], None, ["a"]), m=({"k": 3}, None, ["q"]), ls=(None, None, [old])),
        row(10, 2, 2, v=5, s=(["a"], None, None)), row(20, 1, 2, s=(["z"], True, None)),
        row(10, 1, 3, s=(["a"], None, None)), row(15, 3, 3),
        row(10, 1, 4, ttl=1, s=(["a"], None, None)), row(11, 1, 4, s=(["b"], None, None)),
        row(10, 1, 5, m=({"k": 1}, None, None)), (b"x", timeuuid(12, 9), 0, 4, None, 2, *[None] * 12), row(30, 1, 5, m=({"n": 1}, None, None)),
    ]
    log = spark.createDataFrame(rows, schema)
    want = {1: (None, ["b", "c"], {"k": 3}, ["2"]), 2: (5, ["z"], None, None), 4: (None, ["b"], None, None), 5: (None, None, {"n": 1}, None)}
    for order in ((0, 1, 2), (2, 1, 0)):
        replica = Replica(spark, f"{tmp_path}/{order[0]}", spec)
        for i in order:
            replica.apply(log.where(F.pmod(F.xxhash64("cdc$time"), F.lit(3)) == i), 0)
        got = {r.ck: (r.v.value if r.v and r.v_time else None, r.s, r.m, r.l) for r in replica.rows(10**7).collect()}
        assert got == want
    images = [row(10, 2, 1, 0, v=1, s=(["a"], None, None)), row(10, 9, 1, 1, v=1, s=(["a", "b"], None, None)), row(20, 1, 1, 0, v=2), row(20, 9, 1, 1, s=(["c"], None, None)), row(30, 1, 1, 0, v=9), row(10, 2, 2, 0, v=1)]
    replica = Replica(spark, f"{tmp_path}/post", spec, Mode.POSTIMAGE)
    replica.apply(spark.createDataFrame(images, schema))
    assert [(r.ck, r.v_time, r.s, r.m) for r in replica.rows(0).collect()] == [(1, "", ["c"], None)]


def test_replica_keeps_what_a_new_checkpoint_numbers_anew(spark, small, tmp_path):
    """Batch ids start at 0 again, parts are merged, and old ones are deleted; ranges are applied."""
    log = spark.read.parquet(f"{small}/multi_ck_scylla_cdc_log.parquet")
    replica = Replica(spark, str(tmp_path / "r"), MULTI_CK)
    for i in range(10):
        replica.apply(log.where(F.pmod(F.xxhash64(F.lower("cdc$time")), F.lit(10)) == i), i % 2)
    want = fold.current(log, MULTI_CK, P5_NOW_US).select("pk", "c1", "c2", "v_time").collect()
    assert sorted(map(tuple, replica.rows(P5_NOW_US).select("pk", "c1", "c2", "v_time").collect()), key=str) == sorted(map(tuple, want), key=str)
    names = [p.name for p in (tmp_path / "r").iterdir() if not p.name.startswith(".")]
    assert replica.version() == 10 and sum(n.startswith("current-") for n in names) == 2 and sum(n.startswith("part-") for n in names) <= 9


def test_stream_pairing_is_the_state_machine(spark, tmp_path):
    import random
    import time

    r = random.Random(2)
    rows = [(r.randrange(3), i, i, r.randrange(1, 10)) for i in range(200)]
    schema = "stream int, us long, seq long, op int"
    frames = [rows[:90], rows[90:150], rows[150:]]
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)  # the source takes files by age
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = paired(src, "stream").writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("paired").collect()
    want = [machine([(q_, o) for s, _, q_, o in rows if s == k]) for k in range(3)]
    assert {(x.cause_seq, x.seq) for x in got if x.kind == "range"} == {p for w in want for p in w[0]}
    assert {x.seq for x in got if x.kind == "orphan"} == {p for w in want for p in w[1]}
    assert {(x.cause_seq, x.seq, x.op) for x in got if x.kind == "postimage"} == {p for w in want for p in w[2]}


def test_kslack_corrects_until_the_bound(spark, tmp_path):
    import time

    h = HOUR_US
    frames = [
        [("k", "a", 10, 20), ("k", "b", 30, 40), ("j", "x", 5, 50)],
        [("k", "c", 20, h + 1), ("k", "a", 10, h + 2)],
        [("k", "late", 15, 7 * h), ("clock", "t", 7 * h, 7 * h + 10_000_000)],
        [("clock", "t2", 7 * h, 7 * h + 20_000_000), ("k", "too late", 16, 7 * h + 20_000_000)],
        [("clock", "t3", 7 * h, 7 * h + 30_000_000)],
    ]
    schema = "key string, id string, us long, arrived_us long"
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = kslack(src, "key").writeStream.format("memory").queryName("kslack").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r for r in spark.table("kslack").collect() if r.period_us == 0]
    k = [(r.status, r.n, r.first_us, r.last_us, r.longest_gap_us) for r in got if r.key == "k"]
    assert k[:3] == [("provisional", 2, 10, 30, 20), ("provisional", 3, 10, 30, 10), ("provisional", 4, 10, 30, 10)]
    assert [x for x in k if x[0] == "final"] == [("final", 4, 10, 30, 10)]
    assert [(r.status, r.n) for r in got if r.key == "j"][-1] == ("final", 1)


def _kslack_rows(spark, tmp_path, frames, **options):
    import time

    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)
    src = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = "kslack_" + tmp_path.name.replace("-", "_")
    q = kslack(src, "key", **options).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_kslack_takes_batches_out_of_arrival_order(spark, tmp_path):
    h, s = HOUR_US, 1_000_000
    frames = [
        [("k", "a", 10, 100 * s), ("k", "far", 11, 8 * h)],
        [("k", "b", 20, 200 * s), ("k", "far", 11, 8 * h)],
        [("k", "c", 40, 100 * s)],
        [("k", "d", 70, 150 * s), ("k", "far", 11, 300 * s), ("k", "beyond", 12, 8 * h)],
        [("clock", "t", 8 * h, 9 * h)],
        [("clock", "t2", 8 * h, 9 * h)],
        [("k", "a", 10, 9 * h), ("k", "beyond", 12, 9 * h), ("k", "e", 30, 50 * s), ("k", "e", 30, 9 * h)],
        [("k", "e", 30, 9 * h)],
    ]
    frames = [spark.createDataFrame(f, "key string, id string, us long, arrived_us long") for f in frames]
    got = [r for r in _kslack_rows(spark, tmp_path, frames, disorder_us=h + h // 2) if r.key == "k" and r.period_us == 0]
    rows = [(r.status, r.n, r.first_us, r.last_us, r.longest_gap_us, r.n_too_late) for r in got]
    assert rows == [
        ("provisional", 1, 10, 10, 0, 1), ("provisional", 2, 10, 20, 10, 1), ("provisional", 3, 10, 40, 20, 1),
        ("provisional", 5, 10, 70, 30, 1), ("final", 5, 10, 70, 30, 1), ("too_late", 5, 10, 70, 30, 2),
    ]


def test_kslack_by_change_time_is_the_batch(spark, small, tmp_path):
    """The log in order of change time, as the source delivers it: an eighth of the changes, with all their repeats."""
    from tidelog.functions import timeuuid as tu
    from tidelog.operators import lateness

    log = spark.read.parquet(paths(small)["log"])
    rows = with_keys(log, tu.micros(F.col("cdc$time")).alias("us"), arrived_us(log).alias("arrived_us")).where("us is not null and arrived_us is not null")
    events = rows.select(F.lit("all").alias("key"), F.concat_ws("/", *KEYS).alias("id"), "us", "arrived_us").where("pmod(xxhash64(id), 8) = 0").cache()
    lo, hi, spread = events.agg(F.min("us"), F.max("us"), F.max(F.col("arrived_us") - F.col("us"))).first()
    step = (hi - lo) // 4 + 1
    frames = [events.where(f"us >= {lo + i * step} and us < {lo + (i + 1) * step}") for i in range(4)]
    end = hi + 100 * HOUR_US + 2 * spread
    frames += [spark.createDataFrame([("clock", f"t{i}", end, end)], events.schema) for i in range(2)]
    _kslack_rows(spark, tmp_path, frames, disorder_us=spread, slices=3)
    from tidelog.streaming.kslack import merged

    got = merged(spark.table("kslack_" + tmp_path.name.replace("-", "_")).where("status = 'final'")).collect()
    want = lateness.per_period(lateness.buffered(events, ["key", "id"], "us", "arrived_us"), ["key"], "us").collect()
    finals = [(r.period_us, r.n, r.n_too_late, r.first_us, r.last_us, r.longest_gap_us) for r in got if r.key == "all"]
    assert sorted(finals, key=str) == sorted(((r.period_us, r.n_final, r.n_too_late, r.first_event_us, r.last_event_us, r.longest_gap_us) for r in want), key=str)


def test_kslack_drops_its_state(spark, tmp_path):
    """A repeat within ``forget_us`` counts once, one that comes after the state was dropped starts anew."""
    h = HOUR_US
    frames = [[("k", "a", 10, 20)], [("c", "t", 8 * h, 8 * h)], [("c", "t1", 8 * h, 8 * h)], [("k", "b", 12, 8 * h)], [("k", "b", 12, 8 * h)], [("c", "t2", 20 * h, 20 * h)], [("c", "t3", 20 * h, 21 * h)], [("k", "b", 12, 22 * h)]]
    frames = [spark.createDataFrame(f, "key string, id string, us long, arrived_us long") for f in frames]
    got = [(r.status, r.n, r.n_too_late) for r in _kslack_rows(spark, tmp_path, frames, forget_us=h) if r.key == "k"]
    assert got[0] == ("provisional", 1, 0) and ("final", 1, 0) in got and got.count(("too_late", 1, 1)) == 1
    assert got[-1][0] != "too_late" and got[-1][1] == 0


def test_manifest_survives_failures(spark, tmp_path):
    inc = Incremental(spark, str(tmp_path / "in"), str(tmp_path / "m"), str(tmp_path / "out"))

    def put(name, values):
        spark.createDataFrame([(v,) for v in values], "x int").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{name}")

    def seen():
        c = inc.committed()
        return [] if c is None else sorted(r.x for r in c.select("x").collect())

    assert inc.run(lambda d: d) is None and seen() == []
    put("a", [1, 2])
    put("b", [3])

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        inc.run(lambda d: d, before_commit=fail)
    assert seen() == [] and inc.pending().count() == 2
    put("c", [4])
    assert inc.run(lambda d: d) and seen() == [1, 2, 3, 4]
    assert inc.run(lambda d: d) is None and seen() == [1, 2, 3, 4]
    put("d", [5])
    inc.run(lambda d: d.where("x > 4"))
    assert seen() == [1, 2, 3, 4, 5]
    sums = with_checksums(listing(spark, str(tmp_path / "in"))).collect()
    assert len(sums) == 4 and len({r.checksum for r in sums}) == 4 and all(len(r.checksum) == 32 for r in sums)


def test_manifest_replaces_changed_files_and_reads_only_candidates(spark, tmp_path):
    import os

    inc = Incremental(spark, str(tmp_path / "in"), str(tmp_path / "m"), str(tmp_path / "out"))
    (tmp_path / "in").mkdir()

    def put(name, values):
        pq.write_table(pa.table({"x": values}), tmp_path / "in" / f"{name}.parquet")

    def seen():
        return sorted(r.x for r in inc.committed().select("x").collect())

    put("a", [1, 2])
    put("b", [7])
    first = inc.run(lambda d: d)
    assert seen() == [1, 2, 7] and inc.candidates().count() == 0
    put("a", [1, 2, 3])
    second = inc.run(lambda d: d)
    assert seen() == [1, 2, 3, 7] and second != first
    assert {r.batch for r in inc.manifest().collect()} == {second} and inc.run(lambda d: d) is None
    os.utime(tmp_path / "in" / "b.parquet", (1, 1))
    assert inc.candidates().count() == 1 and inc.pending().count() == 0 and inc.run(lambda d: d) is None
    put("c", [9])
    inc.run(lambda d: d)
    put("a", [1])
    os.remove(tmp_path / "in" / "b.parquet")
    inc.run(lambda d: d)
    assert seen() == [1, 9]


def test_arrivals_and_keys(spark, small):
    log = spark.read.parquet(paths(small)["log"])
    assert with_keys(log, arrived_us(log).alias("a")).columns == [*KEYS, "a"]


def test_command_line(spark, small, tmp_path, capsys, monkeypatch):
    from pyspark.sql import SparkSession

    from tidelog import __main__ as cli

    monkeypatch.setattr(SparkSession, "stop", lambda self: None)
    log = paths(small)["log"]
    cli.main(["print", log, "--checkpoint", str(tmp_path / "p"), "--once"])
    lines = [x for x in capsys.readouterr().out.splitlines() if " -> Row[" in x]
    assert len(lines) == spark.read.parquet(log).count()
    cli.main(["replicate", log, str(tmp_path / "r"), "--checkpoint", str(tmp_path / "q"), "--once", "--partition-key", "pk", "--clustering-key", "ck", "--ignore", "arrived_at", "delivery_batch"])
    got = Replica(spark, str(tmp_path / "r"), SCALAR).rows(P5_NOW_US)
    assert got.count() == fold.current(spark.read.parquet(log), SCALAR, P5_NOW_US).count()
