"""Decoding, modes, vnodes, generations, ordered operators, preimages and collections on small cases."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions import collection as c
from tidelog.model import Mode, TableSpec
from tidelog.operators import decode, elements, generations, ordered, preimage, vnodes


def test_modes():
    assert Mode.parse(None) is Mode.DELTA
    assert [Mode.parse(x) for x in ("delta", "preimage", "postimage")] == list(Mode)
    for bad in ("Delta", "", "both"):
        with pytest.raises(ValueError, match="Wrong mode"):
            Mode.parse(bad)


@pytest.mark.parametrize(("mode", "bad", "good"), [(Mode.DELTA, [0, 9, 10, -1, None], [1, 8]), (Mode.PREIMAGE, [9, 12], [0, 8]), (Mode.POSTIMAGE, [0], [1, 9, 12])])
def test_refused_operations_fail_the_query(spark, mode, bad, good):
    df = spark.createDataFrame([(x,) for x in good], "op int")
    assert decode.checked(df, mode).count() == len(good) and [r.op for r in decode.checked(df, mode).collect()] == good
    for x in bad:
        with pytest.raises(Exception, match="not supported"):
            decode.checked(spark.createDataFrame([(x,)], "op int"), mode).collect()


def test_cells_and_projections(spark):
    df = spark.createDataFrame(
        [(b"\x01", 1, None, False, None, 7), (b"\x01", 1, None, True, None, 7), (b"\x01", 2, 3.0, True, 5, 7), (b"\x01", 3, None, None, 2**40, 7)],
        "`cdc$stream_id` binary, `cdc$operation` byte, v double, `cdc$deleted_v` boolean, `cdc$ttl` long, pk long",
    )
    assert [(r.op, r.state) for r in decode.cell_states(df, [F.col("pk")], ["v"]).collect()] == [(1, "unset"), (1, "null"), (2, "value")]
    assert [r[0] for r in df.select(decode.ttl()).collect()] == [None, None, 5, None]
    assert decode.without_metadata(df).columns == ["v", "pk"]
    assert decode.printed(df.limit(1), ["pk", "v"]).first().line == "01 -> Row[7, NULL]"
    assert decode.printed(df.limit(1)).first().line == "01 -> Row[01, 1, NULL, false, NULL, 7]"
    spec = TableSpec.of("t", df.select("pk", "v"), ("pk",))
    assert spec.columns == ("v",) and spec.primary_key == ("pk",)
    with pytest.raises(ValueError, match="no columns"):
        TableSpec.of("t", df, ("nope",))
    made = df.select(decode.dispatch(F.col("cdc$operation"), {1: F.lit("none"), 2: F.col("v").cast("string"), 3: F.lit("gone")}))
    assert [r[0] for r in made.collect()] == ["none", "none", "3.0", "gone"]
    with pytest.raises(Exception, match="no handler for operation 3"):
        df.select(decode.dispatch(F.col("cdc$operation"), {1: F.lit(1), 2: F.lit(2)})).collect()


@pytest.mark.parametrize(("ring", "streams", "want"), [
    ([0, 10, 50, 10], [("a", -50), ("b", 0), ("c", 10), ("d", 11), ("e", 99), ("n", None), ("c", 10)], {(10, False): "c", (50, False): "d", (0, True): "abe"}),
    ([0], [("a", -1), ("b", 5)], {(0, True): "ab"}),
    ([0, 10, 50], [("a", -1), ("b", 0)], {(0, True): "ab"}),
    ([0, 10, 50], [("a", 5)], {(10, False): "a"}),
    ([], [("a", 5)], {}),
])
def test_vnode_tasks(spark, ring, streams, want):
    s = spark.createDataFrame([(x.encode(), t) for x, t in streams], "stream_id binary, token long")
    r = spark.createDataFrame([(t,) for t in ring], "token long")
    got = vnodes.tasks(vnodes.stream_vnodes(s, r)).collect()
    assert {(x.vnode_token, x.wraparound): b"".join(map(bytes, x.streams)).decode() for x in got} == want
    assert all(x.n_streams == len(x.streams) and x.first_stream == bytes(x.streams[0]).hex().upper() for x in got)
    merged = vnodes.tasks(vnodes.stream_vnodes(s, r, max_ring=-1)).collect()
    assert sorted(map(str, merged)) == sorted(map(str, got))


def test_long_ring_is_merged(spark):
    import random

    x = random.Random(1)
    ring = [x.randrange(-(2**63), 2**63) for _ in range(300)] + [-(2**63), 5, 5, None]
    streams = [(bytes([i % 256, i // 256]), x.choice([x.randrange(-(2**63), 2**63), x.choice(ring[:-1])])) for i in range(900)] + [(b"n", None)]
    r = spark.createDataFrame([(t,) for t in ring], "token long")
    s = spark.createDataFrame(streams, "stream_id binary, token long")
    one, two = (sorted(map(tuple, vnodes.stream_vnodes(s, r, max_ring=m).collect())) for m in (10**6, 10))
    assert one == two and len(one) == 900


def test_generations(spark):
    g = spark.createDataFrame([(datetime(2026, 1, d), [b"a"] * (d != 3)) for d in (3, 1, 2, 2)] + [(None, [b"x"])], "time timestamp_ntz, streams array<binary>")
    day, first = 86_400_000_000, 1_767_225_600_000_000
    got = sorted(((r.start_us - first) // day, r.end_us and (r.end_us - first) // day) for r in generations.generations_of(g).collect())
    assert got == [(0, 1), (1, 2), (2, None)]
    assert [r.start_us for r in generations.generations_of(g, first + 30_000_000).collect()] == [first]
    assert generations.generations_of(g, first + 29_999_999).count() == 0
    assert [tuple(r) for r in generations.next_generation(g, first).collect()] == [(first + day, first + 2 * day)]
    assert [tuple(r) for r in generations.next_generation(g, first + day).collect()] == [(first + 2 * day, None)]
    assert generations.next_generation(g, first + 2 * day).count() == 0
    assert generations.generation_end(g, first + 2 * day).first().end_us is None
    assert generations.streams_of(g).count() == 2 and generations.streams_of(g, first + 2 * day).count() == 0
    assert generations.generations_of(g.limit(0)).count() == 0


def machine(ops):
    pairs, orphans, post, start, last = [], [], [], None, None
    for seq, op in ops:
        if op in (5, 6):
            start = seq
        elif op in (7, 8):
            (orphans.append(seq) if start is None else pairs.append((start, seq)))
            start = None
        elif op >= 9 and last and last[1] in (1, 2):
            post.append((last[0], seq, last[1]))
        last = (seq, op)
    return pairs, orphans, post


@pytest.mark.parametrize("slice_us", [None, 1, 7, 10**9])
def test_pairing_is_the_state_machine(spark, slice_us):
    r = random.Random(1)
    rows = [(s, i // 3, i, r.randrange(1, 11)) for i in range(600) for s in [r.randrange(5)]]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "stream int, us long, seq long, op int")
    want = [machine([(q, o) for s, _, q, o in rows if s == k]) for k in range(5)]
    key = (["stream"], ["us", "seq"])
    assert {(x.start.seq, x.seq) for x in ordered.range_pairs(df, *key, ["seq"], slice_us).collect()} == {p for w in want for p in w[0]}
    assert {x.seq for x in ordered.range_orphans(df, *key, slice_us).collect()} == {p for w in want for p in w[1]}
    assert {(x.cause.seq, x.seq, x.applied_op) for x in ordered.postimages(df, *key, ["seq"], slice_us).collect()} == {p for w in want for p in w[2]}


def test_preimages(spark):
    schema = "k int, a int, target_0 string"
    target = spark.createDataFrame([(1, 1, "x"), (2, 1, None), (3, None, "x"), (None, 1, "x")], schema)
    pre = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, None, "y"), (4, None, None), (5, None, "z"), (None, 1, "x")], schema)
    got = {x.k: tuple(x)[1:] for x in preimage.mismatches(pre, target, ["k"], ["a", "target_0"]).collect()}
    none = (None, None, None)
    assert got == {1: none, 2: ("a", "1", "2"), 3: ("target_0", "x", "y"), 4: none, 5: ("missing row", None, None), None: none}


def test_collection_expressions(spark):
    u = ["00000001-0001-11f1-8080-808080808080", "ffffffff-0001-11f1-8080-808080808080", "00000000-0002-11f1-8080-808080808080"]
    df = spark.createDataFrame([([2, 1], [3, 1], {"a": 1, "b": 2}, {"b": 9, "c": 3}, {u[1]: 2, u[2]: 3, u[0]: 1}, ["a"])], "s array<int>, t array<int>, m map<string,int>, n map<string,int>, l map<string,int>, k array<string>")
    got = df.select(
        c.set_add(F.col("s"), F.col("t")).alias("sa"), c.set_remove(F.col("s"), F.col("t")).alias("sr"), c.map_put(F.col("m"), F.col("n")).alias("mp"),
        c.map_remove(F.col("m"), F.col("k")).alias("mr"), c.list_values(F.col("l")).alias("lv"), c.list_values(c.list_delete(F.col("l"), F.array(F.lit(u[1])))).alias("ld"),
        c.list_values(c.list_set(F.col("l"), F.create_map(F.lit(u[0]), F.lit(7)))).alias("ls"), c.overwrite(F.col("s"), F.col("t")).alias("o"),
    ).first()
    assert tuple(got) == ([1, 2, 3], [2], {"a": 1, "b": 9, "c": 3}, {"b": 2}, [1, 2, 3], [1, 3], [7, 2, 3], [3, 1])


def test_collection_replay(spark):
    schema = "pk int, us long, s array<int>, `cdc$deleted_elements_s` array<int>, `cdc$deleted_s` boolean"
    rows = [(1, 1, [1, 2], None, None), (1, 2, [3], [1, 3], None), (1, 2, None, [2], False), (2, 1, [1], None, None), (2, 5, [9], None, True), (2, 4, [8], None, None), (3, None, [1], None, None), (4, 1, None, None, True)]
    rows = rows * 2
    random.Random(0).shuffle(rows)
    live = elements.current_elements(spark.createDataFrame(rows, schema), ["pk"], "s", "set").collect()
    assert sorted((x.pk, x.elem) for x in live) == [(1, 3), (2, 9)]
