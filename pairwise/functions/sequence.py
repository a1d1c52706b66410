"""Sequence composition and autocovariance from letter and pair counts of whole Arrow batches.

The values of a sequence, its length, 20 residue shares and the mean squared property difference at lags
1..10 for three properties, all follow from two histograms: of its letters (20 residues and one code for
anything else), and for each lag of its 21 x 21 pairs of letters. Histograms add up, so a sequence may be
cut into blocks that overlap by ten letters and are counted apart.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pairwise.constants import MAX_LAG, PROPERTY_NAMES, RESIDUE_PROPERTIES, RESIDUES

OTHER = len(RESIDUES)  # the code of a letter that is no residue
LETTERS = OTHER + 1
PAIRS = LETTERS * LETTERS
SLICE = 128 << 10  # bytes of text that are counted at a time: the arrays of a slice stay in the processor cache
ROWS = 512  # rows that are counted at a time; a row has 4,410 pair counts

_CODES = np.full(256, OTHER, np.int64)
_CODES[[ord(residue) for residue in RESIDUES]] = range(OTHER)


def residue_zscores() -> np.ndarray:
    """20 x 3 residue properties in standard units (population deviation), residues sorted."""
    table = np.array([RESIDUE_PROPERTIES[residue] for residue in RESIDUES])
    return (table - table.mean(axis=0)) / table.std(axis=0)


def residue_table(spark):
    """The same as a 20-row frame."""
    rows = [(aa, *map(float, z)) for aa, z in zip(RESIDUES, residue_zscores())]
    columns = ", ".join(f"{name.lower()} double" for name in PROPERTY_NAMES)
    return spark.createDataFrame(rows, f"residue string, {columns}")


def pair_weights() -> np.ndarray:
    """For each pair of letters: the squared difference of each property, and one; zero if either is no residue."""
    z = residue_zscores()
    weights = np.zeros((LETTERS, LETTERS, len(PROPERTY_NAMES) + 1))
    weights[:OTHER, :OTHER, :-1] = (z[:, None, :] - z[None, :, :]) ** 2
    weights[:OTHER, :OTHER, -1] = 1.0
    return weights.reshape(PAIRS, -1)


class Coded(NamedTuple):
    """Letters of the rows of a batch as codes; row r has those from first[r] to first[r + 1]."""

    codes: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def coded(column: pa.Array) -> Coded:
    """One code for each character; a character of several bytes is no residue."""
    data, first = text_bytes(column)
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return Coded(_CODES[data], first)
    return Coded(_CODES[data[lead]], np.concatenate(([0], np.cumsum(lead)))[first])


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ROWS rows and about SLICE bytes of text (one row at least)."""
    _, first = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = min(row + ROWS, int(np.searchsorted(first, first[row] + SLICE, "right")) - 1)
        end = max(end, row + 1)
        yield batch.slice(row, end - row)
        row = end


def letter_counts(letters: Coded, own: np.ndarray | None = None) -> np.ndarray:
    """rows x 21; of the first own letters of each row."""
    rows, row, codes = len(letters.first) - 1, letters.row, letters.codes
    index = row * LETTERS + codes
    if own is not None:
        index = index[np.arange(len(codes)) - letters.first[row] < own[row]]
    return np.bincount(index, minlength=rows * LETTERS).reshape(rows, LETTERS)


def pair_counts(letters: Coded, own: np.ndarray | None = None) -> np.ndarray:
    """rows x lags x 441; of pairs whose first letter is among the first own letters of its row."""
    rows, row, codes = len(letters.first) - 1, letters.row, letters.codes
    counts = np.zeros((rows, MAX_LAG, PAIRS), np.int64)
    base = row * PAIRS + codes * LETTERS
    counted = None if own is None else np.arange(len(codes)) - letters.first[row] < own[row]
    for lag in range(1, min(MAX_LAG, len(codes) - 1) + 1):
        inside = row[:-lag] == row[lag:]
        if counted is not None:
            inside &= counted[:-lag]
        index = (base[:-lag] + codes[lag:])[inside]
        counts[:, lag - 1] = np.bincount(index, minlength=rows * PAIRS).reshape(rows, PAIRS)
    return counts


def vectors(letters: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows x 51: length, residue shares, and for each property its mean squared difference at each lag."""
    length = letters.sum(axis=1)
    shares = letters[:, :OTHER] / np.maximum(length, 1)[:, None]
    sums = pairs @ weights
    means = sums[:, :, :-1] / np.maximum(sums[:, :, -1:], 1)
    lags = means.transpose(0, 2, 1).reshape(len(letters), -1)
    return np.concatenate([length[:, None].astype(float), shares, lags], axis=1)


def as_lists(table: np.ndarray) -> pa.Array:
    offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(table).ravel()))
