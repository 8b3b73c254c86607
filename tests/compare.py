"""Compare a query with its oracle: names, row count and values without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).iterdir()):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{source}'")
    return con


def _plain(x):
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(x)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return sorted(tuple(_plain(x) for x in r) for r in zip(*columns, strict=True))


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    a = query(spark, sf_dir).toArrow()
    b = con.sql(sql).to_arrow_table()
    if sorted(a.column_names) != sorted(b.column_names):
        return f"columns {sorted(a.column_names)} and {sorted(b.column_names)}"
    x, y = rows_of(a), rows_of(b)
    if x == y:
        return ""
    xs, ys = set(x), set(y)
    return f"{len(x)} and {len(y)} rows; only here {sorted(xs - ys)[:3]}; only in SQL {sorted(ys - xs)[:3]}"
