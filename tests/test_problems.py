"""The operators of p1 to p4 and p6 on small tables: nulls, ties, repeats, empty tables, clashing names, and brute force."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu
from tidelog.operators import asof, dedup, incremental, lateness, skew

LOG = "id string, no int, arrived long, copy_rank int, m map<string,int>"


def test_first_copy_is_kept_whatever_the_order(spark):
    rows = [("a", 1, 5, 9, {"x": 1}), ("a", 1, 3, 8, None), ("a", 1, 3, 7, {"y": 2}), ("b", None, None, 1, None), ("b", None, 4, 2, None), (None, 1, 1, 0, None), (None, 1, 2, 0, None), ("c", 1, 1, 1, None)]
    want = {("a", 1, 3, 7), ("b", None, 4, 2), (None, 1, 1, 0), ("c", 1, 1, 1)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, LOG).repartition(3)
        got = dedup.first_copies(df, ["id", "no"], "arrived")
        assert got.columns == df.columns
        assert {(r.id, r.no, r.arrived, r.copy_rank) for r in got.collect()} == want
        assert {tuple(r) for r in dedup.repeated(df, ["id", "no"], "arrived").collect()} == {("a", 1), ("b", None), (None, 1)}


def test_repeated_rows_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "id string, arrived long")
    plan = dedup.repeated(df, ["id"], "arrived")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_new_batches_are_appended_once(spark):
    stored = spark.createDataFrame([("a", 1), (None, 1)], "id string, no int")
    batch = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), ("b", 1, 8), (None, 1, 2)], "id string, no int, arrived long")
    new = dedup.unseen(batch, stored, ["id", "no"], "arrived")
    assert [tuple(r) for r in new.collect()] == [("b", 1, 8)]
    again = dedup.unseen(batch, stored.unionByName(new.select("id", "no")), ["id", "no"], "arrived")
    assert again.count() == 0
    assert dedup.unseen(batch.limit(0), stored, ["id", "no"], "arrived").count() == 0


def test_unprocessed(spark):
    runs = spark.createDataFrame(
        [(1, 1, 3, "started"), (1, 1, 3, "committed"), (1, 1, 3, "committed"), (2, 5, 6, "failed"), (3, 2000, 2**31 - 1, "committed"), (4, None, 9, "committed"), (5, 9, 8, "committed")],
        "run_id long, first_batch int, last_batch int, status string",
    )
    rows = [("done", 3), ("done", 5), ("late", 5), ("late", 6), ("none", None), ("part", None), ("part", 1), ("far", 3000), (None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "id string, batch int")
    assert {r.id for r in incremental.unprocessed(df, ["id"], "batch", runs).collect()} == {"late", "none", None}
    assert incremental.unprocessed(df.limit(0), ["id"], "batch", runs).count() == 0
    assert incremental.unprocessed(df, ["id"], "batch", runs.limit(0)).count() == 6


@pytest.mark.parametrize("bins", [64, 5000, None])
def test_quantiles_are_exact(spark, bins):
    r = np.random.default_rng(bins or 1)
    rows = [("hot", int(x)) for x in r.integers(-(10**15), 10**15, 700)] + [("ties", 5)] * 200 + [(f"k{i % 40}", int(i)) for i in range(200)]
    rows += [(None, 1), (None, None), ("no value", None), ("min", -(2**40)), ("min", 2**40)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = {x.k: tuple(x)[1:] for x in skew.per_key(df, "k", "v", (0.5, 0.9, 0.0, 1.0), hot_share=0.1, bins=bins).collect()}
    by: dict = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert got.keys() == by.keys()
    for k, values in by.items():
        s = sorted(v for v in values if v is not None)
        q = [s[max(1, -(-int(round(p * 10**6)) * len(s) // 10**6)) - 1] if s else None for p in (0.5, 0.9, 0.0, 1.0)]
        assert got[k] == (len(values), s[0] if s else None, s[-1] if s else None, *q), k


def test_keys_under_the_share_but_over_the_rows_are_refined(spark, monkeypatch):
    rows = [(f"k{i % 30}", (i * 7919) % 1009) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    calls = []
    refine = skew._refine
    monkeypatch.setattr(skew, "_refine", lambda *a: calls.append(len(a[3])) or refine(*a))
    monkeypatch.setattr(skew, "KEYS_A_PASS", 25)
    got = {x.k: (x.n_rows, x.q0) for x in skew.per_key(df, "k", "v", (0.5,), hot_share=0.5, hot_rows=50).collect()}
    by: dict = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert got == {k: (len(v), sorted(v)[(len(v) + 1) // 2 - 1]) for k, v in by.items()}
    assert calls[:2] == [25, 5]


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 3 + [("b",)] * 2, "k string")
    assert {(r.k, r.n_rows) for r in skew.heavy_keys(df, "k", 0.3).collect()} == {("a", 5), (None, 3)}
    assert skew.heavy_keys(df.limit(0), "k", 0.3).count() == 0
    many = spark.createDataFrame([(i % 1000 if i % 3 else -1,) for i in range(9000)], "k long")
    for passes in (1, 2, 3):
        assert {tuple(r) for r in skew.heavy_keys(many, "k", 0.02, passes).collect()} == {(-1, 3000)}
    assert skew.heavy_keys(many, "k", 1e-5).count() == many.distinct().count()
    empty = spark.createDataFrame([], "k string, v long")
    assert skew.per_key(empty, "k", "v").count() == 0


def brute_as_of(facts, entity, t):
    known = [f for f in facts if f[0] == entity and None not in f[:3] and f[2] <= t and f[1] <= t]
    if entity is None or t is None or not known:
        return None
    return max(known, key=lambda f: (f[1], f[2], f[3]))[3]


@pytest.mark.parametrize("most", [10**6, 0])
def test_as_known_agrees_with_brute_force(spark, most):
    r = random.Random(4)
    facts = [(r.choice("abcdef"), r.randrange(30), r.randrange(30), r.randrange(9)) for _ in range(150)] + [(None, 1, 1, 1), ("a", None, 1, 1), ("a", 1, None, 1)]
    facts += facts[:20]
    events = [(r.choice("aaaaabcdefg"), r.randrange(-2, 35), i) for i in range(400)] + [(None, 3, 400), ("a", None, 401)]
    f = spark.createDataFrame(facts, "entity string, valid long, known long, x int")
    e = spark.createDataFrame(events, "who string, t long, id int").repartition(4)
    got = asof.as_known(e, "who", "t", f, ["x"], max_facts=most)
    assert got.columns == ["who", "t", "id", "x"]
    rows = got.collect()
    assert len(rows) == len(events)
    for x in rows:
        assert x.x == (None if x.t is None else brute_as_of(facts, x.who, x.t)), x
    assert asof.as_known(e, "who", "t", f.limit(0), ["x"], max_facts=most).where("x is null").count() == len(events)
    assert asof.as_known(e.limit(0), "who", "t", f, ["x"], max_facts=most).count() == 0
    with pytest.raises(ValueError, match="already have"):
        asof.as_known(e, "who", "t", f.withColumnRenamed("x", "ID"), ["ID"])


@pytest.mark.parametrize("most", [5, 40])
def test_an_entity_with_many_facts_is_cut(spark, monkeypatch, most):
    monkeypatch.setattr(asof, "SHARD_FACTS", most)
    r = random.Random(most)
    facts = [(r.choice("aaaaaaab"), r.randrange(200), r.randrange(200), i) for i in range(400)] + [("c", 3, 4, 1)]
    events = [(r.choice("aaab"), r.randrange(-5, 220), i) for i in range(500)] + [("c", 9, 500), (None, 3, 501), ("a", None, 502)]
    f = spark.createDataFrame(facts, "entity string, valid long, known long, x int")
    e = spark.createDataFrame(events, "who string, t long, id int").repartition(4)
    rows = asof.as_known(e, "who", "t", f, ["x"], max_facts=0).collect()
    assert len(rows) == len(events)
    for x in rows:
        assert x.x == (None if x.t is None else brute_as_of(facts, x.who, x.t)), x


def test_old_versions_of_the_tree_stay():
    t = asof.PersistentTree(np.array([0, 0, 0]), np.array([10, 20, 10]), np.array([1, 2, 3]))
    at = t.find(np.zeros(4, np.int64), np.array([0, 30, 30, 2]))
    assert at.tolist() == [-1, 1, 1, -1]
    assert t.find(np.zeros(2, np.int64), np.array([15, 12])).tolist() == [2, 2]
    roots = t.roots.tolist()
    assert len(set(roots)) == 3 and t.fact[roots[0]] == 0


def test_membership_of_a_stream_that_leaves_and_returns(spark):
    a, b = b"a", b"b"
    g = spark.createDataFrame(
        [(datetime(2026, 1, 1), [a, b]), (datetime(2026, 1, 2), [b]), (datetime(2026, 1, 2), [b]), (datetime(2026, 1, 3), []), (datetime(2026, 1, 4), [a]), (None, [b])],
        "time timestamp_ntz, streams array<binary>",
    )
    facts = asof.membership_facts(g, tu.epoch_us(g, "time"))
    day = 86_400_000_000
    first = 1_767_225_600_000_000
    got = {(bytes(r.entity).decode(), (r.valid - first) // day, r.listed) for r in facts.collect()}
    assert got == {("a", 0, True), ("b", 0, True), ("a", 1, False), ("b", 2, False), ("a", 3, True)}


def test_lateness_limits(spark):
    h = tu.HOUR_US
    rows = [("on", 10, h - 1), ("on", 10, 9 * h), ("edge", 10, h), ("last", 10, 7 * h), ("over", 10, 7 * h + 1), ("early", h + 5, 0), ("none", None, 1), ("lost", 5, None)]
    df = spark.createDataFrame(rows, "id string, us long, arrived long")
    events = lateness.buffered(df, ["id"], "us", "arrived")
    assert {r.id: r.fate for r in events.collect()} == {"on": "on_time", "edge": "correction", "last": "correction", "over": "too_late", "early": "on_time"}
    got = {r.period_us: tuple(r)[1:] for r in lateness.per_period(events, [], "us").collect()}
    assert got == {0: (1, 2, 3, 1, 10, 10, 0, 0), h: (1, 0, 1, 0, h + 5, h + 5, 0, 0)}
    assert {r.id for r in lateness.corrections(events, [], ["id"], "us").collect()} == {"edge", "last"}


def test_release_is_in_event_order_and_gaps_cross_slices(spark):
    r, h = random.Random(8), tu.HOUR_US
    rows = [(r.choice("aab"), i, us := r.randrange(3 * h), us + r.choice([0, h // 2, 5 * h, 9 * h])) for i in range(300)]
    rows += rows[:50] + [(None, 900, 7, 7), (None, 901, 7, 7), ("a", 902, None, 5)]
    df = spark.createDataFrame(rows, "k string, id long, us long, arrived long").repartition(5)
    events = lateness.buffered(df, ["k", "id"], "us", "arrived")
    out = lateness.released(events, ["k"], ["id"], "us").collect()
    groups: dict = {}
    for x in out:
        groups.setdefault((x.k, x.period_us, x.slice), []).append((x.released_no, x.us, x.id))
    for g in groups.values():
        assert [n for n, _, _ in sorted(g)] == list(range(1, len(g) + 1)) and [y[1:] for y in sorted(g)] == sorted(y[1:] for y in g)
    got = {(x.k, x.period_us): (x.n_final, x.n_too_late, x.provisional_gap_us, x.longest_gap_us) for x in lateness.per_period(events, ["k"], "us").collect()}

    def gap(times):
        times = sorted(times)
        return max((b - a for a, b in zip(times, times[1:])), default=0)

    first = {(k, i): (us, a) for k, i, us, a in rows if us is not None}
    want: dict = {}
    for (k, _), (us, a) in first.items():
        p = us // h * h
        w = want.setdefault((k, p), ([], [], []))
        (w[2] if a > p + 7 * h else w[1]).append(us)
        if a < p + h:
            w[0].append(us)
    assert got == {key: (len(w[1]), len(w[2]), gap(w[0]), gap(w[1])) for key, w in want.items()}


def test_time_of_a_zoneless_timestamp_doesnt_depend_on_the_session(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1),)], "t timestamp_ntz")
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.select(tu.epoch_us(df, "t")).first()[0] == 1_767_225_600_000_000
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_uuid_times(spark):
    import uuid

    ids = ["8d780cca-e9c9-11f0-805e-4955f9f11dcb", "8D780CCA-E9C9-11F0-805E-4955F9F11DCB", "00000000-0000-1000-8000-000000000000", "short", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "u string").select(tu.ticks(F.col("u"))).collect()]
    assert got == [*[uuid.UUID(x).time - tu.EPOCH_TICKS for x in ids[:3]], None, None]
    neg = spark.createDataFrame([(-1,), (-10,), (9,)], "x long").select(tu.floor_div(F.col("x"), 10)).collect()
    assert [r[0] for r in neg] == [-1, -1, 0]
