"""Element counts of compound strings: one pass of numpy over the bytes of an Arrow batch."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pairwise.functions.sequence import text_bytes

# --- fixed values: atoms of a compound string, and the descriptor that counts each element -----
# An atom is a bracket atom or a letter of the organic subset; * is a dummy atom. A bracket atom is an
# opening bracket, digits, a symbol (a capital and perhaps a small letter, or small letters, or *),
# anything but a closing bracket, and a closing bracket.
ORGANIC_LETTERS = "BCNOPSFIbcnops"
ELEMENT_COUNTS = {
    "CarbonCount": "C",
    "NitrogenCount": "N",
    "OxygenCount": "O",
    "SulfurCount": "S",
    "PhosphorusCount": "P",
    "FluorineCount": "F",
    "ChlorineCount": "Cl",
    "BromineCount": "Br",
    "IodineCount": "I",
}
# letters that stand for an element outside brackets; Cl also contains the letter C
PLAIN_LETTERS = {
    "C": "Cc", "N": "Nn", "O": "Oo", "S": "Ss", "P": "Pp",
    "F": "F", "I": "I",
}
HALOGENS = ["F", "Cl", "Br", "I"]
COUNT_NAMES = [*ELEMENT_COUNTS, "HalogenCount", "HeavyAtomCount", "AtomCount", "NO_Count"]
# ----------------------------------------------------------------------------------------------

_SYMBOLS = list(ELEMENT_COUNTS.values())
HEAVY, DUMMY, NOTHING = len(_SYMBOLS), len(_SYMBOLS) + 1, len(_SYMBOLS) + 2
_WIDTH = NOTHING + 1
SLICE = 128 << 10  # bytes of text that are counted at a time: the arrays of a slice stay in the processor cache

_PLAIN = np.full(256, NOTHING, np.int64)
for _symbol, _letters in PLAIN_LETTERS.items():
    _PLAIN[[ord(c) for c in _letters]] = _SYMBOLS.index(_symbol)
_PLAIN[ord("*")] = DUMMY
_HEAVY = np.zeros(256, bool)
_HEAVY[[ord(c) for c in ORGANIC_LETTERS]] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True


def _next(marked: np.ndarray) -> np.ndarray:
    """For each place the next marked place at or behind it, or the length."""
    n = len(marked)
    at = np.where(marked, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def _brackets(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each bracket atom, and where its symbol starts.

    An atom reaches to the next closing bracket, so of the opening ones before it the first that is
    followed by a symbol counts.
    """
    n = len(data)
    start = np.flatnonzero(data == ord("["))
    end = _next(data == ord("]"))[start]
    start, end = start[end < n], end[end < n]
    same = row[start] == row[end]
    start, end = start[same], end[same]
    symbol = _next(~_DIGIT[data])[start + 1]
    first = data[np.minimum(symbol, n - 1)]
    valid = (symbol < end) & (_UPPER[first] | _LOWER[first] | (first == ord("*")))
    start, end, symbol = start[valid], end[valid], symbol[valid]
    _, of = np.unique(end, return_index=True)
    return start[of], end[of], symbol[of]


def element_counts(column: pa.Array) -> np.ndarray:
    """rows x 13, in the order of COUNT_NAMES."""
    data, offsets = text_bytes(column)
    rows, n = len(offsets) - 1, len(data)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.zeros((rows, _WIDTH), np.int64)
    if n:
        start, end, symbol = _brackets(data, row)
        edges = np.zeros(n + 1, np.int64)
        edges[start] += 1
        edges[end + 1] -= 1
        plain = np.cumsum(edges[:-1]) == 0

        def add(of: np.ndarray, kind):
            np.add(counts, np.bincount(of * _WIDTH + kind, minlength=rows * _WIDTH).reshape(rows, _WIDTH), out=counts)

        add(row[plain], _PLAIN[data[plain]])
        add(row[plain & _HEAVY[data]], HEAVY)
        pair = plain[:-1] & plain[1:] & (row[:-1] == row[1:])
        for name in ("Cl", "Br"):
            found = np.flatnonzero(pair & (data[:-1] == ord(name[0])) & (data[1:] == ord(name[1])))
            add(row[found], _SYMBOLS.index(name))
            if name == "Cl":  # its C is no carbon
                counts[:, _SYMBOLS.index("C")] -= np.bincount(row[found], minlength=rows)
        kind = _symbol_kinds(data, symbol)
        add(row[start], kind)
        heavy = kind != DUMMY
        heavy &= ~_is_hydrogen(data, symbol)
        add(row[start[heavy]], HEAVY)
    elements, heavy, dummies = counts[:, :HEAVY], counts[:, HEAVY], counts[:, DUMMY]
    halogens = elements[:, [_SYMBOLS.index(x) for x in HALOGENS]].sum(axis=1)
    both = elements[:, _SYMBOLS.index("N")] + elements[:, _SYMBOLS.index("O")]
    return np.column_stack([elements, halogens, heavy, heavy + dummies, both])


def _symbol_letters(data: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First letter as a capital, second letter or 0, and whether there are more than two."""
    n = len(data)
    first = data[symbol]
    letter = [data[np.minimum(symbol + k, n - 1)] for k in (1, 2)]
    second = _LOWER[letter[0]]
    third = second & _LOWER[first] & _LOWER[letter[1]]  # a capital takes one small letter, small letters take all
    return np.where(_LOWER[first], first - 32, first), np.where(second, letter[0], 0), third


def _symbol_kinds(data: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    first, second, more = _symbol_letters(data, symbol)
    kind = np.full(len(symbol), NOTHING, np.int64)
    for k, name in enumerate(_SYMBOLS):
        kind[(first == ord(name[0])) & (second == (ord(name[1]) if len(name) > 1 else 0)) & ~more] = k
    kind[data[symbol] == ord("*")] = DUMMY
    return kind


def _is_hydrogen(data: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    first, second, _ = _symbol_letters(data, symbol)
    return (first == ord("H")) & (second == 0)


def _sliced(column: pa.Array) -> Iterator[pa.Array]:
    _, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield column.slice(row, end - row)
        row = end


def _census(column: pa.Array) -> pa.Array:
    counts = np.concatenate([element_counts(part) for part in _sliced(column)] or [np.zeros((0, len(COUNT_NAMES)), np.int64)])
    offsets = np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel(), pa.int64()))
    return lists if not column.null_count else pc.if_else(column.is_valid(), lists, None)


def census(text: Column) -> Column:
    """The 13 count descriptors of a compound string as an array, explicit hydrogens left out; null for null."""
    return F.arrow_udf(_census, "array<bigint>")(text)


def with_census(df: DataFrame, text: str) -> DataFrame:
    """Add the 13 count descriptors of the compound string in ``text``."""
    counted = df.withColumn("_census", census(F.col(text)))
    return counted.withColumns({name: F.get("_census", F.lit(k)) for k, name in enumerate(COUNT_NAMES)}).drop("_census")
