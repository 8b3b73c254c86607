"""p5: the fold against a slow state machine, in any order and with repeats; covering ranges against brute force."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions.timeuuid import EPOCH_TICKS
from tidelog.model import MULTI_CK, TableSpec
from tidelog.operators import fold
from tidelog.operators.stabbing import LOWEST, cover_max, range_max

MULTI = "`cdc$stream_id` binary, `cdc$time` string, `cdc$batch_seq_no` int, `cdc$operation` byte, `cdc$ttl` long, `cdc$deleted_v` boolean, pk long, c1 long, c2 long, v double, extra string"
NOW = 2_000_000


def timeuuid(us: int, node: int) -> str:
    t = us * 10 + EPOCH_TICKS
    return str(uuid.UUID(fields=(t & 0xFFFFFFFF, t >> 32 & 0xFFFF, t >> 48 & 0xFFF | 0x1000, 0x80, 0x80, node)))


def random_log(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        us, pk, stream = r.randrange(40), r.randrange(3), bytes([r.randrange(2)])
        t, ttl = timeuuid(us, i), r.choice([None, None, 1, 2])
        kind = r.choice([1, 1, 1, 2, 2, 3, 4, 5])
        c1, c2 = r.randrange(4), r.randrange(4)
        if kind == 5:
            whole = r.random() < 0.5
            lo, hi = (r.choice([None, 0, 1, 2]), None), (r.choice([None, 1, 2, 3]), None)
            if not whole:
                lo, hi = (c1, r.choice([None, 0, 1])), (c1, r.choice([2, 3]))
            rows.append((stream, t, 0, r.choice([5, 6]), None, None, pk, *lo, None, "x"))
            if r.random() < 0.8:
                rows.append((stream, t, 1, r.choice([7, 8]), None, None, pk, *hi, None, "x"))
            continue
        v = r.choice([None, 1.0, 2.0, 3.0]) if kind in (1, 2) else None
        flag = r.choice([None, False, True]) if kind in (1, 2) else None
        rows.append((stream, t, 0, kind, ttl if kind in (1, 2) else None, flag, pk, None if kind == 4 else c1, None if kind == 4 else c2, v, "x"))
    return rows


def slow(rows: list[tuple], now: int) -> dict:
    """pk, c1, c2 to the uuid of v's change; by the statement, row by row."""
    rows = sorted(set(rows), key=lambda x: (x[0], x[1], x[2]))
    us = {x[1]: (uuid.UUID(x[1]).time - EPOCH_TICKS) // 10 for x in rows}
    cells, marks, dead, ranges, start = {}, {}, {}, [], None
    for stream, t, _, op, ttl, flag, pk, c1, c2, v, _ in rows:
        w = us[t]
        end = 2**63 - 1 if ttl is None else w + ttl * 1_000_000
        if op in (1, 2) and (v is not None or flag):
            new = (w, v is None, v if v is not None else 0, end, t)
            cells[pk, c1, c2] = max(cells.get((pk, c1, c2), new), new)
        if op == 2:
            marks[pk, c1, c2] = max(marks.get((pk, c1, c2), (w, end)), (w, end))
        if op == 3:
            dead[pk, c1, c2] = max(dead.get((pk, c1, c2), w), w)
        if op == 4:
            dead[pk] = max(dead.get(pk, w), w)
        if op in (5, 6):
            start = (stream, t, op, pk, c1, c2)
        if op in (7, 8):
            if start and start[:2] == (stream, t):
                ranges.append((pk, start[2], start[4], start[5], op, c1, c2, w))
            start = None

    def below(a, b, incl):
        return a < b or (incl and a == b)

    out = {}
    for key in {*cells, *marks}:
        pk, c1, c2 = key
        d = [dead.get(key, -1), dead.get(pk, -1)]
        for p, so, s1, s2, eo, e1, e2, w in ranges:
            if p != pk:
                continue
            if s2 is None and e2 is None:
                hit = (s1 is None or below(s1, c1, so == 5)) and (e1 is None or below(c1, e1, eo == 7))
            else:
                hit = c1 == s1 == e1 and (s2 is None or below(s2, c2, so == 5)) and (e2 is None or below(c2, e2, eo == 7))
            if hit:
                d.append(w)
        d = max(d)
        cell, mark = cells.get(key), marks.get(key)
        v_live = cell and not cell[1] and cell[3] > now and cell[0] > d
        if v_live or (mark and mark[1] > now and mark[0] > d):
            out[key] = cell[4] if v_live else ""
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold_is_the_state_machine_in_any_order(spark, seed):
    rows = random_log(seed, 250)
    want = slow(rows, NOW)
    r = random.Random(seed)
    rows = rows + r.sample(rows, 60)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, MULTI).repartition(3)
    got = {(x.pk, x.c1, x.c2): x.v_time for x in fold.current(df, MULTI_CK, NOW).collect()}
    assert got == want and want


def test_states_merge(spark):
    rows = [x for x in random_log(9, 300) if x[3] in (1, 2, 3)]
    changes = fold.decoded(spark.createDataFrame(rows, MULTI), ["pk", "c1", "c2", "v"])
    whole = fold.row_states(changes, ["pk"], ["c1", "c2"], ["v"])
    parts = [fold.row_states(fold.decoded(spark.createDataFrame(x, MULTI), ["pk", "c1", "c2", "v"]), ["pk"], ["c1", "c2"], ["v"]) for x in (rows[:120], rows[100:])]
    merged = fold.merge_states(*parts, ["pk"], ["c1", "c2"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_late_write_loses_to_a_kept_tombstone(spark):
    t = [timeuuid(10, 1), timeuuid(5, 2)]
    deleted = spark.createDataFrame([(b"s", t[0], 0, 3, None, None, 1, 1, 1, None, "")], MULTI)
    late = spark.createDataFrame([(b"s", t[1], 0, 2, None, None, 1, 1, 1, 4.0, "")], MULTI)
    states = [fold.row_states(fold.decoded(x, ["pk", "c1", "c2", "v"]), ["pk"], ["c1", "c2"], ["v"]) for x in (deleted, late)]
    merged = fold.merge_states(*states, ["pk"], ["c1", "c2"]).withColumn("deleted_us", F.col("row_deleted_us"))
    assert fold.live_rows(merged, ["v"], NOW).count() == 0


def test_nulls_and_empty(spark):
    rows = [(b"s", None, 0, 2, None, None, 1, 1, 1, 1.0, ""), (b"s", timeuuid(1, 1), 0, None, None, None, 1, 1, 1, 1.0, ""), (b"s", timeuuid(1, 1), 0, 2, None, None, None, 1, 1, 1.0, ""), (b"s", timeuuid(1, 2), 0, 2, None, None, 1, None, None, 1.0, "")]
    df = spark.createDataFrame(rows, MULTI)
    assert [(x.pk, x.c1, x.c2) for x in fold.current(df, MULTI_CK, NOW).collect()] == [(1, None, None)]
    assert fold.current(df.limit(0), MULTI_CK, NOW).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_cover_max(spark, partitions):
    r = random.Random(partitions)
    points = [(r.choice([0, 0, 0, 0, 1, 2]), r.randrange(60), r.randrange(3), i) for i in range(600)] + [(0, None, 1, 600), (None, 1, 1, 601), (1, 1, None, 602)]
    intervals = []
    for i in range(120):
        a, b = sorted([(r.randrange(60), r.randrange(3), r.choice([-1, 1])) for _ in range(2)])
        if a < b:
            intervals.append((r.choice([0, 0, 1]), a, b, r.randrange(1000)))
    intervals += intervals[:10]
    p = spark.createDataFrame(points, "pk long, c1 long, c2 long, slab int")
    point = "struct<p0: struct<flag: int, value: long>, p1: struct<flag: int, value: long>, side: int>"
    rows = [(pk, *[((0, x[0]), (0, x[1]), x[2]) for x in (a, b)], u) for pk, a, b, u in intervals]
    iv = spark.createDataFrame(rows, f"pk long, lo {point}, hi {point}, us long")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cover_max(p, iv, "best", ["pk"], ["c1", "c2"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(points)
    for x in got:
        hits = [] if None in (x.pk, x.c1, x.c2) else [u for pk, a, b, u in intervals if pk == x.pk and a < (x.c1, x.c2, 0) < b]
        assert x.best == (max(hits) if hits else None), x
    assert cover_max(p, iv.limit(0), "best", ["pk"], ["c1", "c2"]).where("best is not null").count() == 0
    assert cover_max(p.limit(0), iv, "best", ["pk"], ["c1", "c2"]).count() == 0


def test_range_max_is_a_loop():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        lo = r.integers(0, n, 40)
        hi, w = np.minimum(n, lo + r.integers(0, n + 1, 40)), r.integers(-50, 50, 40)
        want = [max((int(u) for a, b, u in zip(lo, hi, w) if a <= i < b), default=LOWEST) for i in range(n)]
        assert range_max(n, lo, hi, w).tolist() == want
    assert range_max(0, lo[:0], lo[:0], lo[:0]).tolist() == []


def test_ranges_over_three_columns_of_other_types(spark):
    """Text, date-like and number clustering columns, two partition columns, prefixes of every length."""
    r = random.Random(5)
    letters, rows, log = "abcd", [], []
    schema = "`cdc$stream_id` binary, `cdc$time` string, `cdc$batch_seq_no` int, `cdc$operation` byte, `cdc$ttl` long, p string, q int, a string, b int, c string, v string"
    for i in range(300):
        rows.append((r.choice("xy"), r.randrange(2), r.choice(letters), r.randrange(4), r.choice(letters), i))
        log.append((b"s", timeuuid(50, i), 0, 2, None, *rows[-1][:5], "v"))
    ranges = []
    for i in range(60):
        p, q, fixed, depth = r.choice("xy"), r.randrange(2), (r.choice(letters), r.randrange(4), r.choice(letters)), r.randrange(3)
        lo, hi = [list(fixed[:depth]) + [r.choice([None, r.randrange(4) if depth == 1 else r.choice(letters)])] for _ in range(2)]
        lo, hi = [x + [None] * (3 - len(x)) for x in (lo, hi)]
        so, eo, us, t = r.choice([5, 6]), r.choice([7, 8]), r.randrange(100), None
        t = timeuuid(us, 1000 + i)
        log += [(b"s", t, 0, so, None, p, q, *lo, None), (b"s", t, 1, eo, None, p, q, *hi, None)]
        ranges.append((p, q, lo, hi, so, eo, us))
    spec = TableSpec("t", ("p", "q"), ("a", "b", "c"), ("v",))
    df = spark.createDataFrame(log, schema).withColumn("cdc$deleted_v", F.lit(False))
    got = {(x.p, x.q, x.a, x.b, x.c) for x in fold.current(df, spec, 0).collect()}

    def dead(row):
        for p, q, lo, hi, so, eo, us in ranges:
            if (p, q) != row[:2] or us < 50:
                continue
            d = max([i for i in range(3) if lo[i] is not None or hi[i] is not None], default=0)
            key = row[2:5]
            if any(key[i] != (lo[i] if lo[i] is not None else hi[i]) for i in range(d)):
                continue
            if (lo[d] is None or key[d] > lo[d] or (so == 5 and key[d] == lo[d])) and (hi[d] is None or key[d] < hi[d] or (eo == 7 and key[d] == hi[d])):
                return True
        return False

    want = {x[:5] for x in rows if not dead(x)}
    assert got == want and 0 < len(want) < len({x[:5] for x in rows})
