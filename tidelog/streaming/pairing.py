"""Range pairing and postimages over a stream, one slot of state per log stream and kind.

The state of a stream is the range start waiting for its end, and the operation just before. Rows of a stream that arrive
together are put in order of time and batch sequence first; the source never splits a point in time over batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = T.StructType([T.StructField("stream", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("cause_seq", T.LongType()), T.StructField("op", T.IntegerType())])


class _Slots(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getValueState("slots", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.slots.get()[0]) if self.slots.exists() else {"start": None, "last": None}
        out = []
        frame = pd.concat(list(rows)).sort_values(["us", "seq"])
        for seq, op in zip(frame["seq"].tolist(), frame["op"].tolist(), strict=True):
            if op in (5, 6):
                state["start"] = seq
            elif op in (7, 8):
                if state["start"] is None:
                    out.append((key[0], "orphan", seq, None, op))
                else:
                    out.append((key[0], "range", seq, state["start"], op))
                state["start"] = None
            elif op >= 9 and state["last"] and state["last"][1] in (1, 2):
                out.append((key[0], "postimage", seq, state["last"][0], state["last"][1]))
            state["last"] = [seq, op]
        self.slots.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=OUT.names).astype({"cause_seq": "Int64"})

    def close(self) -> None:
        pass


def paired(changes: DataFrame, stream: str, keep: Sequence[str] = ("us", "seq", "op")) -> DataFrame:
    """(stream, kind, seq, cause_seq, op): range pairs, orphaned range ends and postimages of a streaming ``changes``
    (``stream``, us, seq, op). Needs the RocksDB state store."""
    rows = changes.selectExpr(f"cast(`{stream}` as string) as stream", *keep)
    return rows.groupBy("stream").transformWithStateInPandas(_Slots(), OUT, "append", "none")
