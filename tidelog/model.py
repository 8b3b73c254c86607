"""Table descriptions, operation codes and replay modes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Op(IntEnum):
    PREIMAGE = 0
    UPDATE = 1
    INSERT = 2
    ROW_DELETE = 3
    PARTITION_DELETE = 4
    RANGE_START_INCLUSIVE = 5
    RANGE_START_EXCLUSIVE = 6
    RANGE_END_INCLUSIVE = 7
    RANGE_END_EXCLUSIVE = 8
    POSTIMAGE = 9


class Mode(Enum):
    """How a replay treats operations; exact lower-case names, delta by default."""

    DELTA = "delta"
    PREIMAGE = "preimage"
    POSTIMAGE = "postimage"

    @classmethod
    def parse(cls, text: str | None) -> Mode:
        if text is None:
            return cls.DELTA
        try:
            return cls(text)
        except ValueError:
            raise ValueError(f"Wrong mode {text}; one of {[m.value for m in cls]}") from None

    def refused(self) -> tuple[str, ...]:
        """The operations that are an error in this mode, as a condition on ``op``."""
        return {
            Mode.DELTA: ("op = 0", "op > 8", "op < 0", "op is null"),
            Mode.PREIMAGE: ("op > 8", "op < 0", "op is null"),
            Mode.POSTIMAGE: ("op = 0", "op < 0", "op is null"),
        }[self]


@dataclass(frozen=True)
class TableSpec:
    """A base table: partition key, clustering key, other columns, and which of these are unfrozen collections."""

    name: str
    partition_key: tuple[str, ...]
    clustering_key: tuple[str, ...]
    columns: tuple[str, ...]
    collections: tuple[tuple[str, str], ...] = ()

    @property
    def scalars(self) -> tuple[str, ...]:
        """The columns that are no collections."""
        return tuple(c for c in self.columns if c not in dict(self.collections))

    @property
    def ranges(self) -> bool:
        """Whether rows may be deleted by ranges of the clustering key."""
        return bool(self.clustering_key)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return self.partition_key + self.clustering_key

    @classmethod
    def of(
        cls, name: str, df: DataFrame, partition_key: tuple[str, ...], clustering_key: tuple[str, ...] = (), lists: tuple[str, ...] = ()
    ) -> TableSpec:
        """From a schema: maps and arrays are collections. In a log a list is a map from time-based uuid to value, so ``lists``
        names those maps that are lists. A key column that is missing is an error."""
        missing = {*partition_key, *clustering_key} - set(df.columns)
        if missing:
            raise ValueError(f"{name} has no columns {sorted(missing)}")
        rest = tuple(c for c in df.columns if c not in {*partition_key, *clustering_key})
        kinds = {T.ArrayType: "set", T.MapType: "map"}
        unfrozen = tuple((c, "list" if c in lists else kinds[type(df.schema[c].dataType)]) for c in rest if type(df.schema[c].dataType) in kinds)
        return cls(name, partition_key, clustering_key, rest, unfrozen)


SCALAR = TableSpec("scalar", ("pk",), ("ck",), ("v", "s"))
MULTI_CK = TableSpec("multi_ck", ("pk",), ("c1", "c2"), ("v",))
