"""Encoding a corpus with a public tokenizer, and token counts.

Texts are encoded where they are read, without a shuffle; a batch of rows leaves Python as one array of ids. Null and
empty texts give an empty list and the count 0. Other columns aren't read. Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.bpe import TOKENIZER_DIR, encoder

BYTE_BPE = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: Texts encoded at once; bounds the memory of a Python worker.
ROWS = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encoded(df: DataFrame, key: str, text: str, ids: str = "ids", vocabulary: str = BYTE_BPE) -> DataFrame:
    """(key, ids): the encoding of each row's text, without special tokens."""
    rows = df.select(key, text)
    out = T.StructType([rows.schema[key], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in _slices(batches):
            values, offsets = e.encode_batch(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, ids])

    return rows.mapInArrow(run, out)


def counted(df: DataFrame, key: str, text: str, count: str = "n_tokens", vocabulary: str = BYTE_BPE) -> DataFrame:
    """(key, count): the number of tokens of each row's text."""
    rows = df.select(key, text)
    out = T.StructType([rows.schema[key], T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in _slices(batches):
            n = pa.array([e.count(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[key, count])

    return rows.mapInArrow(run, out)
