"""Checking preimages against a target table.

A preimage row is compared with the target's row of the same primary key, null-safe, in column order. Without such a row
it is consistent exactly if all its other columns are null. Both sides come with one row per key; a skewed key can't occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_mismatch(columns: Sequence[tuple[str, Column, Column]], has_row: Column) -> Column:
    """struct(mismatch, expected, found) of the first of the (name, target's value, preimage's value) that differ, or null."""
    text = [(c, t, p, F.struct(F.lit(c).alias("mismatch"), t.cast("string").alias("expected"), p.cast("string").alias("found"))) for c, t, p in columns]
    different = [F.when(~p.eqNullSafe(t), row) for _, t, p, row in text]
    any_value = F.coalesce(*[F.when(p.isNotNull(), F.lit(True)) for _, _, p, _ in text], F.lit(False))
    none = F.lit(None).cast("string")
    missing = F.struct(F.lit("missing row").alias("mismatch"), none.alias("expected"), none.alias("found"))
    return F.when(~has_row, F.when(any_value, missing)).otherwise(F.coalesce(*different, F.lit(None)))


def mismatches(preimages: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, mismatch, expected, found): the first differing column with both values as text; null where consistent.

    'missing row' where the target has none and the preimage has a value.
    """
    t = target.select(*[F.col(f"`{c}`").alias(f"target_{i}") for i, c in enumerate([*key, *columns])], F.lit(True).alias("target_row"))
    same_key = None
    for i, k in enumerate(key):
        one = preimages[f"`{k}`"].eqNullSafe(t[f"target_{i}"])
        same_key = one if same_key is None else same_key & one
    n = len(key)
    pairs = [(c, t[f"target_{n + i}"], preimages[f"`{c}`"]) for i, c in enumerate(columns)]
    first = first_mismatch(pairs, t["target_row"].isNotNull())
    joined = preimages.join(t, same_key, "left")
    return joined.select(*[preimages[f"`{k}`"] for k in key], first.alias("d")).select(*key, "d.mismatch", "d.expected", "d.found")
