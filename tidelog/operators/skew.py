"""Per-key results where a few keys hold most rows.

Counts, extremes and histograms are mergeable, so they're added up in the map tasks and a key reaches the
shuffle as one small row per map task, however many rows it has.

Heavy keys are found by the same refinement over hashes of the keys: bins that hold too few rows for a heavy key are dropped,
the rest are cut again, and only keys in the few bins that remain are counted one by one. So however many keys there are, the
shuffle carries bins.

Exact quantiles: for a hot key the interval that holds a quantile is cut into bins again and again, each pass counting
per (key, quantile, bin), until a bin is one value wide. No value of a hot key is ever gathered. A key is hot if it has more
than ``hot_share`` of all rows or more than ``hot_rows`` rows, so all others fit a sorted shuffle partition, where they are ranked
in one pass.

There are at most ``1 / hot_share`` plus one per ``hot_rows`` rows hot keys; that is the proven bound of what the driver holds,
and of it ``KEYS_A_PASS`` at a time are broadcast. Nulls: a null key is a key; null values are left out of ranks, and a key with no value has a null
quantile. Ties don't matter: a quantile is the value at position ceil(q * n), at least 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import fresh, small_side

HOT_SHARE = 0.001
HOT_ROWS = 5_000_000
#: Hot keys refined in one pass over the rows.
KEYS_A_PASS = 20_000
#: Bits of a key's hash that one pass over the hashes resolves.
HASH_BITS = 16
#: Bins of one pass over all hot keys and quantiles; fewer keys get finer ones and need fewer passes.
MOST_BINS = 4_000_000


def key_counts(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(key, n_rows, n_values, least, greatest) of each key; one pass, added up in the map tasks."""
    v = F.col(value) if value else F.lit(None).cast("long")
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_values"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
    )


def heavy_keys(df: DataFrame, key: str, share: float, passes: int = 2) -> DataFrame:
    """(key, n_rows) of the keys with at least ``share`` of all rows; at most 1 / share rows.

    Each pass counts the rows per bin of ``HASH_BITS`` more bits of the key's hash, within the bins that are left. A bin with
    fewer rows than a heavy key has is dropped, so at most 1 / share are left, known to the driver.
    """
    name, bins = fresh("key_hash", df), fresh("hash_bin", df)
    rows = df.select(key, F.xxhash64(key).alias(name))
    left: list[int] | None = None
    total = df.count()
    least = max(1, share * total)
    for i in range(1, passes + 1):
        prefix = F.shiftrightunsigned(F.col(name), 64 - i * HASH_BITS)
        if left is not None:
            rows = rows.where(F.shiftrightunsigned(F.col(name), 64 - (i - 1) * HASH_BITS).isin(left))
        found = rows.groupBy(prefix.alias(bins)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        left = [r[0] for r in found.select(bins).collect()]
        if not left:
            break
    kept = rows.where(prefix.isin(left) if left else F.lit(False))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def _ranks(state: list[dict], quantiles: Sequence[float]) -> list[dict]:
    out = []
    for k in state:
        for i, q in enumerate(quantiles):
            rank = max(1, -(-int(round(q * 1_000_000)) * k["n_values"] // 1_000_000))
            out.append({"key": k["key"], "q": i, "rank": rank, "lo": k["least"], "hi": k["greatest"]})
    return out


def _refine(df: DataFrame, key: str, value: str, live: list[dict], bins: int | None) -> list[dict]:
    """One pass: narrow each live interval to the bin that holds its rank."""
    spark = df.sparkSession
    bins = bins or max(256, min(65_536, MOST_BINS // len(live)))
    for x in live:
        x["width"] = max(1, -(-(x["hi"] - x["lo"] + 1) // bins))
    names = ("q", "rank", "lo", "hi", "width")
    schema = T.StructType([T.StructField("hot_key", df.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names]])
    state = spark.createDataFrame([(x["key"], *[x[n] for n in names]) for x in live], schema)
    inside = df[key].eqNullSafe(state["hot_key"]) & df[value].between(F.col("lo"), F.col("hi"))
    histogram = (
        df.join(F.broadcast(state), inside)
        .groupBy("hot_key", "q", "rank", F.expr(f"(`{value}` - lo) div width").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Select, per hot key and quantile, the bin where the running count reaches the rank.
    running = F.sum("n").over(Window.partitionBy("hot_key", "q").orderBy("bin"))
    hit = (
        histogram.withColumn("upto", running)
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select("hot_key", "q", "bin", (F.col("upto") - F.col("n")).alias("below"))
    )
    found = {(_plain(r["hot_key"]), r["q"]): r for r in hit.collect()}
    for x in live:
        r = found[(_plain(x["key"]), x["q"])]
        x["rank"] -= r["below"]
        x["lo"] += r["bin"] * x["width"]
        x["hi"] = min(x["hi"], x["lo"] + x["width"] - 1)
    return live


def _plain(key):
    return bytes(key) if isinstance(key, bytearray) else key


def per_key(
    df: DataFrame,
    key: str,
    value: str,
    quantiles: Sequence[float] = (0.5, 0.9),
    hot_share: float = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    bins: int | None = None,
) -> DataFrame:
    """(key, n_rows, least, greatest, q0, q1, ...) of each key: complete, exact, and balanced.

    ``value`` is a long column. ``q<i>`` is the exact quantile ``quantiles[i]``. ``bins`` fixes the bins of a pass.
    """
    df = df.select(key, value)
    counts = key_counts(df, key, value)
    # Counting the rows reads no column of a Parquet table.
    over = min(hot_rows, hot_share * df.count())
    hot = [r.asDict() | {"key": _plain(r[key])} for r in counts.where(F.col("n_rows") > over).collect()]  # bound: see the module
    spark = df.sparkSession
    done = [x for x in _ranks([h for h in hot if h["n_values"]], quantiles)]
    live = [x for x in done if x["lo"] < x["hi"]]
    while live:
        chunks = [live[i : i + KEYS_A_PASS] for i in range(0, len(live), KEYS_A_PASS)]
        live = [x for c in chunks for x in _refine(df, key, value, c, bins) if x["lo"] < x["hi"]]
    names = [f"q{i}" for i in range(len(quantiles))]
    by = {(x["key"], x["q"]): x["lo"] for x in done}
    kind = df.schema[key].dataType
    result = T.StructType(
        [T.StructField(key, kind)] + [T.StructField(n, T.LongType()) for n in ("n_rows", "least", "greatest", *names)]
    )
    rows = [
        (h["key"], h["n_rows"], h["least"], h["greatest"], *[by.get((h["key"], i)) for i in range(len(names))])
        for h in hot
    ]
    hot_result = spark.createDataFrame(rows, result)
    hot_keys = small_side(spark.createDataFrame([(h["key"],) for h in hot], T.StructType([T.StructField("hot_key", kind)])), KEYS_A_PASS)
    cold = df.join(hot_keys, df[key].eqNullSafe(F.col("hot_key")), "left_anti")
    w = Window.partitionBy(key)
    n = F.count(value).over(w)
    place = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last()))
    aggs = [
        F.max(F.when(F.col("place") == F.greatest(F.lit(1), F.expr(f"({round(q * 1_000_000)} * n + 999999) div 1000000")), F.col(value))).alias(m)
        for q, m in zip(quantiles, names, strict=True)
    ]
    cold_result = (
        cold.select(key, value, n.alias("n"), place.alias("place"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(value).alias("least"), F.max(value).alias("greatest"), *aggs)
    )
    return cold_result.unionByName(hot_result)


def salted_left(rows: DataFrame, side: DataFrame, key: Sequence[str], spread_by: Sequence[str], salts: int = 16) -> DataFrame:
    """``rows`` left-joined to ``side``, which has one row per ``key``: rows of one key are spread over ``salts`` tasks by
    ``spread_by``, and the side's row is repeated. Null keys don't match."""
    salt = fresh("join_salt", rows, side)
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Sorted and merged whatever the side's size: a side that grows with the data must not end up broadcast.
    return left.join(right.hint("merge"), [*key, salt], "left").drop(salt)
