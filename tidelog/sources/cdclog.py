"""A change log as a stream source, ``spark.readStream.format("cdclog")``.

The offset is the millisecond up to which the log has been read. It stays ``late_ms`` behind the clock, so that late writes
are in, and before the start of a generation that is younger than ``settle_ms``, whose streams may not be known yet; a change that
turns up in time already read is not seen. A batch ``(start, end]`` is cut at the starts of generations into spans, and in each
only the streams of its generation are read. Progress is in the query's checkpoint, and a batch that is read again gives the
same rows.

A batch reads the log once: its files, in the layout of ``layout.store`` only those of the days and stream buckets that the spans
need, are dealt to ``most_pieces`` tasks by row groups. Within what a task reads at a time, rows come per generation, then per
vnode task and window of ``window_ms`` from the span's start, however long the batch is.

Options: path (Parquet log), generations and ring and tokens (Parquet tables; without them, one task), now_ms (a fixed
clock, for tests), late_ms (10000), settle_ms (30000), window_ms (30000), most_pieces (64; the number of cores is a good one).
"""

from __future__ import annotations

import json
import time
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions.timeuuid import EPOCH_TICKS

DAY_MS = 86_400_000


LAYOUT = ("log_day", "log_bucket")
NOTE = "_layout.json"


def _dataset(path: str) -> ds.Dataset:
    """A Parquet log, plain or in the layout of ``layout.store``, whose folders are then pruned by day."""
    return ds.dataset(path, partitioning="hive")


class Span:
    """Of one generation, the milliseconds ``(lo, hi]`` and the streams with the number of their vnode task; None: all."""

    def __init__(self, generation_ms: int | None, lo_ms: int, hi_ms: int, tasks: list[list[bytes]] | None) -> None:
        self.generation_ms, self.lo_ms, self.hi_ms, self.tasks = generation_ms, lo_ms, hi_ms, tasks


class Piece(InputPartition):
    """Row groups of files, and the spans of the batch."""

    def __init__(self, files: list[tuple[str, list[int]]], spans: list[Span]) -> None:
        self.files, self.spans = files, spans


#: What each byte is worth as a hex digit; 255 if it is none.
_DIGIT = np.full(256, 255, dtype=np.uint8)
_DIGIT[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = np.arange(16)
_DIGIT[np.frombuffer(b"ABCDEF", dtype=np.uint8)] = np.arange(10, 16)
#: The places of a uuid's time digits, the most significant first.
_PLACES = [*range(15, 18), *range(9, 13), *range(8)]


def ticks_of(uuids: pa.Array) -> np.ndarray:
    """100 ns ticks since 1970 of uuid texts; what isn't one, by length or digits, gets the least number."""
    out = np.full(len(uuids), np.iinfo(np.int64).min, dtype=np.int64)
    good = np.asarray(pc.fill_null(pc.equal(pc.binary_length(uuids), 36), False))
    some = uuids.filter(pa.array(good))
    if len(some):
        digits = _DIGIT[np.frombuffer(pc.binary_join(pa.array([some.to_pylist()]), "")[0].as_buffer(), dtype=np.uint8).reshape(-1, 36)[:, _PLACES]]
        value = np.zeros(len(some), dtype=np.int64)
        for i in range(len(_PLACES)):
            value = value * 16 + digits[:, i]
        out[good] = np.where((digits == 255).any(axis=1), np.iinfo(np.int64).min, value - EPOCH_TICKS)
    return out


def bucket_of(stream: bytes, buckets: int) -> int:
    """The bucket in which ``layout.store`` puts a stream."""
    import xxhash

    h = xxhash.xxh64_intdigest(stream, seed=42)
    return (h - 2**64 if h >= 2**63 else h) % buckets


def stored_buckets(path: str) -> int | None:
    """The number of buckets that ``layout.store`` noted, or None."""
    files, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    note = f"{inner}/{NOTE}"
    if files.get_file_info(note).type != pafs.FileType.File:
        return None
    with files.open_input_stream(note) as f:
        return json.loads(f.read())["buckets"]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.late_ms, self.window_ms = int(options.get("late_ms", 10_000)), int(options.get("window_ms", 30_000))
        self.settle_ms = int(options.get("settle_ms", 30_000))
        self.most_pieces = int(options.get("most_pieces", 64))
        self.now_ms = options.get("now_ms")
        self.options = options

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        now = int(self.now_ms) if self.now_ms else int(time.time() * 1000)
        young = [begin - 1 for begin, _, _ in self._tasks() if begin is not None and begin > now - self.settle_ms]
        return {"ms": max(0, min([now - self.late_ms, *young]))}

    def _tasks(self) -> list[tuple[int | None, int | None, list[tuple[int | None, list[bytes] | None]]]]:
        """(start, end, [(vnode, streams)]) of each generation; the metadata is small and read per batch."""
        if "generations" not in self.options:
            return [(None, None, [(None, None)])]
        found: dict[int, set[bytes]] = {}
        for r in ds.dataset(self.options["generations"]).to_table(columns=["time", "streams"]).to_pylist():
            if r["time"] is not None:
                ms = int((r["time"] - type(r["time"])(1970, 1, 1)).total_seconds() * 1000)
                found.setdefault(ms, set()).update(s for s in r["streams"] or [] if s is not None)
        tokens: dict[bytes, int] = {}
        ring: list[int] = []
        if "ring" in self.options and "tokens" in self.options:
            ring = sorted({t for t in ds.dataset(self.options["ring"]).to_table()["token"].to_pylist() if t is not None})
            table = ds.dataset(self.options["tokens"]).to_table(columns=["stream_id", "token"])
            tokens = {s: t for s, t in zip(*(table[c].to_pylist() for c in ("stream_id", "token")), strict=True) if s is not None and t is not None}
        begins, out = sorted(found), []
        for i, ms in enumerate(begins):
            groups: dict[int | None, list[bytes]] = {}
            for s in sorted(found[ms]):
                vnode = ring[bisect_left(ring, tokens[s]) % len(ring)] if ring and s in tokens else None
                groups.setdefault(vnode, []).append(s)
            out.append((ms, begins[i + 1] if i + 1 < len(begins) else None, list(groups.items())))
        return out

    def spans(self, start: dict, end: dict) -> list[Span]:
        out = []
        for begin, until, groups in self._tasks():
            lo = start["ms"] if begin is None else max(start["ms"], begin - 1)
            hi = end["ms"] if until is None else min(end["ms"], until - 1)
            if hi > lo and groups:
                out.append(Span(begin, lo, hi, None if groups[0][1] is None else [streams for _, streams in groups]))
        return out

    def _needed(self, data: ds.Dataset, spans: list[Span]) -> pc.Expression | None:
        """The folders of a stored layout that hold rows of the spans."""
        if LAYOUT[0] not in data.schema.names:
            return None
        day, needed = pc.field(LAYOUT[0]), None
        buckets = stored_buckets(self.path)
        for s in spans:
            one = (day >= s.lo_ms // DAY_MS) & (day <= s.hi_ms // DAY_MS)
            if buckets and s.tasks is not None:
                one = one & pc.field(LAYOUT[1]).isin(sorted({bucket_of(x, buckets) for t in s.tasks for x in t}))
            needed = one if needed is None else needed | one
        return needed

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        spans = self.spans(start, end)
        if not spans:
            return []
        data = _dataset(self.path)
        groups = []
        for f in data.get_fragments(filter=self._needed(data, spans)):
            groups += [(f.path, g.id, g.total_byte_size) for g in f.row_groups]
        # The largest go first, each to the task with the least so far.
        dealt: list[tuple[int, dict[str, list[int]]]] = [(0, {}) for _ in range(min(self.most_pieces, len(groups)))]
        for path, g, size in sorted(groups, key=lambda x: (-x[2], x[0], x[1])):
            i = min(range(len(dealt)), key=lambda k: dealt[k][0])
            dealt[i][1].setdefault(path, []).append(g)
            dealt[i] = (dealt[i][0] + size, dealt[i][1])
        return [Piece(sorted((p, sorted(g)) for p, g in files.items()), spans) for _, files in dealt]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        data = _dataset(self.path)
        names = [c for c in data.schema.names if c not in LAYOUT]
        schema = pa.schema([data.schema.field(c) for c in names])
        kind = schema.field("cdc$stream_id").type
        tasks = []
        for s in partition.spans:
            if s.tasks is not None:
                streams = [x for t in s.tasks for x in t]
                numbers = np.array([i for i, t in enumerate(s.tasks) for _ in t], dtype=np.int64)
                tasks.append((pa.array(streams, kind), numbers))
            else:
                tasks.append(None)
        for path, groups in partition.files:
            whole = ds.ParquetFileFormat().make_fragment(path, filesystem=data.filesystem)
            for b in whole.subset(row_group_ids=groups).to_batches(schema=schema, columns=names):
                t = ticks_of(b["cdc$time"])
                for s, known in zip(partition.spans, tasks, strict=True):
                    hit = (t > s.lo_ms * 10_000 + 9_999) & (t <= s.hi_ms * 10_000 + 9_999)
                    if known is not None:
                        at = pc.fill_null(pc.index_in(b["cdc$stream_id"], value_set=known[0]), -1).to_numpy(zero_copy_only=False)
                        hit &= at >= 0
                    rows = np.flatnonzero(hit)
                    if not len(rows):
                        continue
                    window = (t[rows] // 10_000 - s.lo_ms - 1) // self.window_ms
                    task = known[1][at[rows]] if known is not None else np.zeros(len(rows), dtype=np.int64)
                    yield b.take(pa.array(rows[np.lexsort((window, task))]))

    def commit(self, end: dict) -> None:
        pass


class CdcLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cdclog"

    def schema(self) -> StructType:
        found = _dataset(self.options["path"]).schema
        return from_arrow_schema(pa.schema([f for f in found if f.name not in LAYOUT]), prefer_timestamp_ntz=True)

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(CdcLog)
