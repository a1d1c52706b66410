"""Token counts for fields and sections, from one encoding of the whole document.

The fields are joined by a separator and encoded once. Each token has a span of code points (a token
that holds part of a code point spans all of it). Fields, separators and the lines of the last field
are intervals that cover the text without gaps; tokens and intervals are joined by binary search.

Rule for tokens that cross a boundary: a token belongs to the interval that has most of its
characters, on a tie to the earliest. Counts of all intervals therefore add up to the tokens.

A null field is empty. An empty last field has one section of no tokens. Rows are independent: repeated rows give
repeated results, ids may be null. Only the id and the fields are read, so other columns cannot clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairwise.llm.arrow_text import SLICE, short_batches, slices
from pairwise.llm.byte_bpe import PATTERN, VOCABULARY, codec

SEPARATOR = "\n"
SCHEMA = (
    "id bigint, n_tokens bigint, field_tokens array<bigint>, separator_tokens bigint, "
    "n_crossing bigint, section_tokens array<bigint>"
)


def token_spans(lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last code point (inclusive) of tokens with these byte lengths."""
    last = np.cumsum(lengths) - 1
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return points[last - lengths + 1], points[last]


def allocate(first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each interval bounds[k]:bounds[k + 1], and how many cross a boundary."""
    a = np.searchsorted(bounds, first, "right") - 1
    b = np.searchsorted(bounds, last, "right") - 1
    crossing = np.flatnonzero(a != b)
    for t in crossing:
        inner = np.clip(bounds[a[t] : b[t] + 2], first[t], last[t] + 1)
        a[t] += np.argmax(np.diff(inner))  # the first of the largest
    return np.bincount(a, minlength=len(bounds) - 1), len(crossing)


def count_tokens(values: list[str], separator: str, path: str, pattern: str):
    """Tokens, tokens by field, of separators, crossing tokens, tokens by line of the last field."""
    own = codec(path, pattern)
    text = separator.join(values)
    raw = text.encode()
    ids = np.array(own.encoding.encode_ordinary(text), np.int64)
    lines = [line + "\n" for line in values[-1].split("\n")]
    lines[-1] = lines[-1][:-1]
    sizes = [n for value in values[:-1] for n in (len(value), len(separator))] + [len(x) for x in lines]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    if not len(ids):
        counts, crossing = np.zeros(len(sizes), np.int64), 0
    else:
        counts, crossing = allocate(*token_spans(own.lengths[ids], raw), bounds)
    n = len(values) - 1
    sections = counts[2 * n :]
    fields = [*counts[: 2 * n : 2].tolist(), int(sections.sum())]
    return len(ids), fields, int(counts[1 : 2 * n : 2].sum()), crossing, sections.tolist()


def token_counts(
    df: DataFrame,
    fields: tuple[str, ...] = ("lang", "source", "text"),
    key: str = "doc_id",
    separator: str = SEPARATOR,
    path: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    picked = short_batches(df).select(
        F.col(key).cast("bigint").alias("id"),
        *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)],
    )
    last = f"f{len(fields) - 1}"

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, last, SLICE):
                texts = zip(*(batch.column(k + 1).to_pylist() for k in range(len(fields))), strict=True)
                found = [count_tokens(list(values), separator, path, pattern) for values in texts]
                columns = zip(*found, strict=True) if found else [[]] * 5
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
                    ["id", "n_tokens", "field_tokens", "separator_tokens", "n_crossing", "section_tokens"],
                )

    return picked.mapInArrow(rows, SCHEMA).withColumnRenamed("id", key)
