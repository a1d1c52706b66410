"""Whole texts of an Arrow column as flat numpy arrays: bytes, words, word hashes."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

SPACE = 0x20
SLICE = 4 << 20  # bytes of text handled at a time
BATCH_ROWS = 2000
WHITE = (0x20, *range(0x09, 0x0E))


def _table(separators, lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = SPACE
    return table


# Byte tables: a separator becomes a space, any other byte stays (or is lower-cased).
UNCHANGED = _table(WHITE, lower=False)
LOWERED = _table(WHITE, lower=True)
ALPHANUMERIC = _table(
    (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)), lower=True
)


class Words(NamedTuple):
    """Words of the rows of a batch. Row r has the words first[r] up to first[r + 1]."""

    first: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None):
    """Starts and ends of the runs of True bytes; a run ends with its row, and where kind changes."""
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.empty(inside.size + 1, bool)
    breaks[0] = breaks[-1] = True
    np.logical_not(inside[:-1] & inside[1:], out=breaks[1:-1])
    if kind is not None:
        breaks[1:-1] |= kind[1:] != kind[:-1]
    breaks[offsets] = True
    return np.flatnonzero(inside & breaks[:-1]), np.flatnonzero(inside & breaks[1:]) + 1


def encode_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray):
    """Dictionary codes of data[start:end] for runs that together are the True bytes of inside."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    encoded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def split_words(texts: pa.Array, table: np.ndarray) -> Words:
    data, offsets = flat(texts)
    folded = table[data]
    inside = folded != SPACE
    starts, ends = runs(inside, offsets)
    codes, vocabulary = encode_runs(folded, starts, ends, inside)
    return Words(np.searchsorted(starts, offsets), codes, vocabulary)


def hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about limit bytes of text each (one row at least)."""
    _, offsets = flat(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def short_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches have fewer rows than Spark's default: a row is a whole text."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # a number that the user has chosen stays
        conf.set(key, str(BATCH_ROWS))
    return df


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names a result column would clash with, in any case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])
