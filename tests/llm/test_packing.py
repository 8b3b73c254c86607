from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import packing


def brute(sizes, counts, k):
    n = len(sizes)

    def cost(i, j):
        return sum((sizes[j - 1] - sizes[t]) * counts[t] for t in range(i, j))

    best = [0] + [cost(0, j) for j in range(1, n + 1)]
    for _ in range(1, k):
        best = [0] + [min([best[j]] + [best[i] + cost(i, j) for i in range(1, j)]) for j in range(1, n + 1)]
    return best[n]


@pytest.mark.parametrize("whole", [2500, 0])
def test_boundaries_are_optimal(monkeypatch, whole):
    monkeypatch.setattr(packing, "WHOLE_TABLE", whole)
    r = np.random.default_rng(0)
    for _ in range(150):
        n, k = int(r.integers(1, 14)), int(r.integers(1, 6))
        s, c = np.sort(r.choice(np.arange(1, 60), n, replace=False)), r.integers(1, 9, n)
        b = packing.optimal_boundaries(s, c, k)
        assert len(b) <= k and b[-1] == s[-1]
        assert sum((b[np.searchsorted(b, x)] - x) * y for x, y in zip(s, c, strict=True)) == brute(s, c, k)


def check(spark, sizes: dict, capacity: int, buckets: int = 256):
    df = spark.createDataFrame(list(sizes.items()), "doc string, n long").repartition(5)
    got = packing.containers(df, "doc", "n", capacity, buckets).collect()
    used: dict = {}
    parts: dict = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.size
        parts.setdefault(r.doc, []).append((r.part, r["first"], r.size))
    assert parts.keys() == sizes.keys()
    for item, p in parts.items():
        n = sizes[item] or 0
        p.sort()
        assert sum(x[2] for x in p) == n
        assert len(p) == max(1, -(-n // capacity))
        assert [x[1] for x in p] == [i * capacity for i in range(len(p))] and [x[0] for x in p] == list(range(len(p)))
    assert max(used.values(), default=0) <= capacity
    assert sorted(used) == list(range(len(used)))
    return used


@pytest.mark.parametrize("shard_rows", [200_000, 97])
def test_every_item_once_and_little_room_left(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    r = np.random.default_rng(2)
    sizes = {f"i{i}": int(x) for i, x in enumerate(np.clip(r.lognormal(4.2, 1.0, 1500), 1, 1500))} | {"none": None, "zero": 0, "huge": 10_000, "exact": 256, "twice": 512}
    used = check(spark, sizes, 256)
    least = sum(x or 0 for x in sizes.values()) / 256
    assert len(used) <= 1.02 * least + 2


def test_one_size_holds_most(spark):
    used = check(spark, {f"a{i}": 100 for i in range(900)} | {f"b{i}": 56 for i in range(300)}, 256)
    assert len(used) <= (900 * 100 + 300 * 56) / 256 * 1.3


def test_few_buckets_still_fit(spark):
    check(spark, {f"i{i}": i % 77 + 1 for i in range(300)}, 80, buckets=3)


def test_empty_and_only_empty(spark):
    assert packing.containers(spark.createDataFrame([], "doc string, n long"), "doc", "n", 8).count() == 0
    assert check(spark, {"a": None, "b": 0}, 8) == {0: 0}


def test_same_containers_whatever_the_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc"), (F.col("id") * 37 % 90 + 1).alias("n"))
    a, b = (sorted(map(tuple, packing.containers(x, "doc", "n", 100).collect())) for x in (df, df.repartition(11)))
    assert a == b


def test_no_document_is_lost(spark, small):
    from tests import compare
    from tidelog.llm import queries

    con = compare.connect(small)
    for name, sql in queries.SQL.items():
        assert compare.difference(spark, con, queries.QUERIES[name], sql, small) == "", name
