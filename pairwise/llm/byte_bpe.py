"""Byte-level BPE by tree reduction.

A text is encoded by halves. Two neighbouring segments form a monoid under :meth:`Codec.join`: tokens
between the outermost *settled* places of a segment are final, and only a window around the cut is
encoded again. The window grows outwards from the cut to the next settled place on either side, through
whole segments if they have none. Decoding concatenates the bytes of halves in the same way.

Why a join is right: a place is settled if a character that is not white space stands before it and
white space after it. In the pattern, white space can only be the first character of a match or belong
to a match of white space only, so no match ever spans such a place; and since a match before it ends
with something other than white space, no look-ahead reaches over it. What stands around a settled
place therefore never changes the tokens on its other side.

Null text is empty and has no tokens. Rows are independent, so repeated rows give repeated results,
and a null id stays null. Input columns that bear the name of a result column are dropped.
"""

import base64
import functools
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from pairwise.llm.arrow_text import SLICE, extended, short_batches, slices, without

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LEAF = 4096  # characters that are encoded in one go


class Segment(NamedTuple):
    """text[start:end] with its first and last settled place, and the tokens between these two."""

    start: int
    end: int
    first: int | None = None
    last: int | None = None
    ids: tuple[list[int], ...] = ()


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first_settled = regex.compile(r"\S\s")
        self.last_settled = regex.compile(r"(?r)\S\s")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens])

    def leaf(self, text: str, start: int, end: int) -> Segment:
        found = self.first_settled.search(text, start, end)
        if not found:
            return Segment(start, end)
        first, last = found.start() + 1, self.last_settled.search(text, start, end).start() + 1
        return Segment(start, end, first, last, (self.encoding.encode_ordinary(text[first:last]),))

    def join(self, text: str, left: Segment, right: Segment) -> Segment:
        if left.first is None or right.first is None:
            known = left if right.first is None else right
            return Segment(left.start, right.end, known.first, known.last, known.ids)
        window = self.encoding.encode_ordinary(text[left.last : right.first])
        return Segment(left.start, right.end, left.first, right.last, (*left.ids, window, *right.ids))

    def segment(self, text: str, start: int, end: int, leaf: int = LEAF) -> Segment:
        if end - start <= leaf:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self.segment(text, start, middle, leaf), self.segment(text, middle, end, leaf))

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        whole = self.segment(text, 0, len(text), leaf)
        if whole.first is None:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        head = self.encoding.encode_ordinary(text[: whole.first])
        tail = self.encoding.encode_ordinary(text[whole.last :])
        return np.concatenate([np.array(ids, np.uint32) for ids in (head, *whole.ids, tail)])

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


@functools.lru_cache(maxsize=2)
def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, convert) -> DataFrame:
    df = short_batches(without(df, target))

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, source, SLICE):
                values = [convert(x) for x in batch.column(source).to_pylist()]
                column = pa.array(values, pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, target])

    return df.mapInArrow(rows, extended(df, T.StructField(target, kind)))


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Add the token ids as bytes: little-endian unsigned 32-bit integers."""
    return _mapped(
        df, text, ids, T.BinaryType(), lambda x: codec(path, pattern).encode(x or "").astype("<u4").tobytes()
    )


def decode(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Add the bytes that the ids stand for; null ids are none."""
    return _mapped(
        df, ids, decoded, T.BinaryType(), lambda x: codec(path, pattern).decode(np.frombuffer(x or b"", "<u4"))
    )
