from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog.operators import topology
from tidelog.operators import windows as w
from tidelog.operators.windows import FetchWindow as W

S = 1_442_872_800_000
# now, end, created, computed; all relative to S.
CASES = [
    (9, None, None, None),
    (9, 1000, None, None),
    (9, 9, None, None),
    (20_000, None, W(0, 10_000), W(0, 10_000)),
    (50_000, None, W(0, 40_000), W(0, 30_000, cropped=True)),
    (20_000, 10_000, W(0, 10_000, last=True), W(0, 10_000, last=True)),
    (50_000, 40_000, W(0, 40_000, last=True), W(0, 30_000, cropped=True)),
    (20_000, 11_000, W(0, 10_000), W(0, 10_000)),
    (50_000, 41_000, W(0, 40_000), W(0, 30_000, cropped=True)),
]


def at(x: W | None) -> W | None:
    return x and W(S + x.start_ms, S + x.end_ms, x.cropped, x.last)


@pytest.mark.parametrize(("now", "end", "created", "computed"), CASES)
def test_windows(now, end, created, computed):
    end = None if end is None else S + end
    assert w.create_window(S, end, S + now) == at(created)
    assert w.compute_window(S, end, S + now) == at(computed)


def test_window_column_agrees(spark):
    rows = [(S, None if e is None else S + e, S + n) for n, e, _, _ in CASES]
    df = spark.createDataFrame(rows, "a long, b long, now long")
    found = df.select("*", w.window_column(F.col("a"), F.col("b"), F.col("now")).alias("w")).collect()
    for r in found:
        want = w.compute_window(r.a, r.b, r.now)
        assert (r.w and W(*r.w)) == want


@pytest.mark.parametrize("last", [False, True])
def test_crop(last):
    assert w.crop_window(W(S, S + 31_000, last=last)) == W(S, S + 30_000, cropped=True)
    same = W(S, S + 30_000, last=last)
    assert w.crop_window(same) is same
    epoch = W(0, S, last=last)
    assert w.crop_window(epoch) is epoch


def test_end_learned_late_gives_an_inverted_last_window():
    x = w.create_window(S + 5_000, S, S + 60_000)
    assert x.last and x.end_ms < x.start_ms


def test_pace_and_text(spark):
    rows = [(None, True), ((1, 2, False, False), True), ((1, 2, False, False), False), ((1, 2, True, False), True)]
    df = spark.createDataFrame(rows, "w struct<start_ms:long,end_ms:long,cropped:boolean,last:boolean>, empty boolean")
    assert [r[0] for r in df.select(w.pace_column(F.col("w"), F.col("empty"))).collect()] == [30_000, 30_000, 10_000, 1_000]
    assert str(W(1, 2, cropped=True)) == "(1, 2](cropped)"


@pytest.mark.parametrize(("fetched", "end", "change", "non_empty", "want"), [
    (1, 1000, 0, 10**9, False), (1, 1000, 1, 10**9, False), (1, None, 1, 10**9, False), (1, None, 2, 10**9, True), (1, None, 0, 0, True),
    (1, None, None, 10**9, False), (1, None, None, None, True), (1, 5, None, None, False),
])
def test_refresh(spark, fetched, end, change, non_empty, want):
    df = spark.createDataFrame([(fetched, end, change, non_empty)], "f long, e long, c long, n long")
    needed = topology.refresh_needed(F.col("f"), F.col("e"), F.col("c"), F.col("n"), F.lit(10**9))
    assert df.select(needed).first()[0] is want


def test_topology_events(spark):
    events = spark.createDataFrame([("add", 3), ("Remove", 7), ("up", 9), ("down", 10), (None, 11), ("add", None), ("add", 3)], "kind string, us long")
    assert sorted(r.us for r in topology.topology_changes(events).collect()) == [3, 3, 7]
    assert topology.last_topology_change(events).collect()[0][0] == 7
    assert topology.last_topology_change(events.limit(0)).collect()[0][0] is None


def test_bucket_edges(spark):
    df = spark.createDataFrame([(S,), (S + 1,), (S + 30_000,), (S + 30_001,), (S - 1,)], "ms long")
    assert [r[0] for r in df.select(w.bucket(F.col("ms"), S)).collect()] == [0, 1, 1, 2, 0]


def test_scan_of_no_streams_is_empty(spark):
    log = spark.createDataFrame([(b"a", "00000001-0001-11f1-8080-808080808080")], "`cdc$stream_id` binary, `cdc$time` string")
    assert w.scan(log, 0, 4 * 10**12).count() == 1
    assert w.scan(log, 0, 4 * 10**12, []).count() == 0
    assert w.scan(log, 0, 4 * 10**12, [b"a"]).count() == 1


def test_whole_log_is_replayed_and_scanned(spark, small):
    from tidelog.functions import timeuuid as tu
    from tidelog.plans import reference
    from tidelog.plans.tables import scalar_log

    log, changes = scalar_log(spark, small), reference.QUERIES["task_scan_all"](spark, small)
    listed = reference.QUERIES["stream_vnodes"](spark, small).select("stream_id").distinct()
    assert changes.select("vnode_token").distinct().count() > 1
    assert changes.count() == log.select(F.hex("cdc$stream_id").alias("stream_id")).join(listed, "stream_id").count() > 0
    last = log.where("`cdc$operation` in (1, 2)").agg(F.max(tu.micros(F.col("cdc$time")))).first()[0]
    assert reference.QUERIES["replay_delta_all"](spark, small).agg(F.max("write_us")).first()[0] == last > reference.REPLAY_TO_MS * 1000
