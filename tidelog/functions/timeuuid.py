"""Time-based uuids as Column expressions; everything stays inside code generation.

A version-1 uuid holds 100 ns ticks since 1582-10-15. Comparisons are made on ticks, microseconds or
milliseconds and never on the text, whose order isn't the order of time. Letter case carries no meaning.
A null uuid, or a text that isn't 36 characters long, has a null time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: ticks between 1582-10-15 and 1970-01-01.
EPOCH_TICKS = 122192928000000000
HOUR_US = 3_600_000_000


def ticks(uuid: Column) -> Column:
    """100 ns ticks since 1970."""
    digits = F.concat(F.substring(uuid, 16, 3), F.substring(uuid, 10, 4), F.substring(uuid, 1, 8))
    return F.when(F.length(uuid) == 36, F.conv(digits, 16, 10).cast("long") - F.lit(EPOCH_TICKS))


def uuid_at(us: Column, node: Column) -> Column:
    """The text of a time-based uuid of microsecond ``us`` whose last 12 digits are the long ``node``."""
    h = F.lpad(F.lower(F.hex(us * F.lit(10) + F.lit(EPOCH_TICKS))), 16, "0")
    tail = F.lpad(F.lower(F.hex(node)), 12, "0")
    return F.concat(F.substring(h, 9, 8), F.lit("-"), F.substring(h, 5, 4), F.lit("-1"), F.substring(h, 2, 3), F.lit("-8080-"), tail)


def _floor(a: Column, by: int) -> Column:
    """Floor division of longs, also below zero."""
    return F.call_function("div", a - F.pmod(a, F.lit(by).cast("long")), F.lit(by).cast("long"))


def micros(uuid: Column) -> Column:
    """Whole microseconds since 1970, the write time of a change."""
    return _floor(ticks(uuid), 10)


def millis(uuid: Column) -> Column:
    """Whole milliseconds since 1970."""
    return _floor(ticks(uuid), 10_000)


def floor_div(a: Column, by: int) -> Column:
    """Floor division of a long column by a positive constant."""
    return _floor(a, by)


def first_tick(ms: Column) -> Column:
    """The smallest tick of a millisecond."""
    return ms * F.lit(10_000)


def last_tick(ms: Column) -> Column:
    """The greatest tick of a millisecond."""
    return ms * F.lit(10_000) + F.lit(9_999)


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of column ``name``; one without a zone is read as UTC whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.unix_micros(F.from_utc_timestamp(df[name].cast("timestamp"), F.current_timezone()))
    return F.unix_micros(df[name])
