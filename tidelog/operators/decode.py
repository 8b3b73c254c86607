"""Changes as expressions: accessors, tri-state cells, projections, dispatch by operation, printing.

A cell is unset (null, not flagged deleted: left alone), null (null and flagged: a tombstone), or a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import Mode, TableSpec

META = "cdc$"


def is_deleted(column: str) -> Column:
    """The deletion flag of a column; null is false."""
    return F.coalesce(F.col(f"`{META}deleted_{column}`"), F.lit(False))


def ttl(column: str = "cdc$ttl") -> Column:
    """The time to live as an int; null stays null, and so does what no int holds."""
    return F.col(f"`{column}`").try_cast("int")


def base_columns(log: DataFrame) -> list[str]:
    """The columns that aren't the log's own."""
    return [c for c in log.columns if not c.startswith(META)]


def without_metadata(log: DataFrame) -> DataFrame:
    return log.select(*[f"`{c}`" for c in base_columns(log)])


def primary_keys(log: DataFrame, spec: TableSpec) -> DataFrame:
    return log.select(*spec.primary_key)


def partition_keys(log: DataFrame, spec: TableSpec) -> DataFrame:
    return log.select(*spec.partition_key)


def state(column: str) -> Column:
    return F.when(F.col(f"`{column}`").isNotNull(), "value").when(is_deleted(column), "null").otherwise("unset")


def cell_states(log: DataFrame, keys: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """(keys, op, col, state) of each column of each insert and update."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), state(c).alias("state")) for c in columns])
    op = F.col("cdc$operation").cast("int")
    return log.where(op.isin(1, 2)).select(*keys, op.alias("op"), F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")


def checked(changes: DataFrame, mode: Mode) -> DataFrame:
    """``changes`` as they are, except that an operation this mode refuses fails the query when it's met."""
    refused = F.expr(" or ".join(mode.refused()))
    message = F.concat(F.lit(f"operation not supported in {mode.value} mode: "), F.coalesce(F.col("op").cast("string"), F.lit("null")))
    return changes.withColumn("op", F.when(refused, F.raise_error(message).cast("int")).otherwise(F.col("op")))


def dispatch(op: Column, handlers: dict[int, Column]) -> Column:
    """What the handler of each change's operation makes of it, in one pass; handlers are the user's strategy, one expression
    of one type per operation. An operation without a handler, or none, fails the query when it's met."""
    message = F.concat(F.lit("no handler for operation "), F.coalesce(op.cast("string"), F.lit("null")))
    chosen = None
    for code, handler in sorted(handlers.items()):
        chosen = F.when(op == int(code), handler) if chosen is None else chosen.when(op == int(code), handler)
    return F.raise_error(message) if chosen is None else chosen.otherwise(F.raise_error(message))


def printed(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(line): HEX(stream) -> row, with all of the row's columns, or ``columns``, joined as text. Null reads NULL, and binary
    values are hex."""

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(log.schema[name].dataType, T.BinaryType):
            c = F.hex(c)
        return F.coalesce(c.cast("string"), F.lit("NULL"))

    fields = F.concat_ws(", ", *[text(c) for c in columns or log.columns])
    return log.select(F.concat(F.coalesce(F.hex("cdc$stream_id"), F.lit("NULL")), F.lit(" -> Row["), fields, F.lit("]")).alias("line"))
