"""Secret scan: fixed patterns, and a pair of character Markov models.

Base patterns: assignments to names such as ``password``, access keys, long hexadecimal strings. The
method adds strings that look drawn at random: a run of key characters is scored by the log-likelihood
ratio of two character Markov models, one of random strings and one of ordinary identifiers.

Both are trained on labelled samples from all documents: runs that a base match touches are random strings;
other runs are ordinary if they are shorter than a candidate or hold no digit, so secrets that no pattern
finds hardly teach what is ordinary. Only counts of character pairs travel, so what tasks send
has a fixed size. Where nothing was seen after a character, a model falls back on how frequent characters are.

A run that overlaps a base match is not reported. Null text is empty and has no spans. Rows are judged one by
one: repeated rows give repeated results, null ids stay null. Only id and text are read.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairwise.llm.arrow_text import SLICE, flat, runs, short_batches, slices

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
MIN_RUN = 16  # characters of a run that may be a secret
MIN_ORDINARY = 3  # characters of a run that trains the model of identifiers
MIN_RATIO = 20.0  # natural logarithm of the likelihood ratio
# fixed patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
N = len(SYMBOLS) + 1  # the last one is the start of a run
_CODE = np.full(256, 255, np.uint8)
_CODE[list(SYMBOLS)] = np.arange(len(SYMBOLS))
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def assigns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]


def accesses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]


def hexes(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]


class Scan:
    """Base matches of a batch of texts and its runs of key characters; all places are bytes of the batch."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = flat(texts)
        rows = len(texts)
        self.codes = _CODE[self.data]
        self.starts, self.ends = runs(self.codes != 255, self.offsets)
        hex_starts, hex_ends = runs(_HEX[self.data], self.offsets)
        long = hex_ends - hex_starts >= MIN_HEX
        with_hex = set((np.searchsorted(self.offsets, hex_starts[long], "right") - 1).tolist())
        self.base: list[list[tuple[str, int, int]]] = [[] for _ in range(rows)]  # code points of the row
        covered = []
        for row in range(rows):
            raw = self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()
            low = raw.lower()  # bytes: A-Z only
            named, access = any(n in low for n in _NAMES), b"AKIA" in raw
            if not (named or access or row in with_hex):
                continue
            text = raw.decode()
            found = [("assign", *s) for s in (assigns(text) if named else ())]
            found += [("access", *s) for s in (accesses(text) if access else ())]
            found += [("hex", *s) for s in (hexes(text) if row in with_hex else ())]
            self.base[row] = sorted(found, key=_order)
            byte = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)) + self.offsets[row]
            covered += [(byte[a], byte[b]) for _, a, b in found]
        n = len(self.data)
        marks = np.zeros(n + 1, np.int64)
        for a, b in covered:
            marks[a] += 1
            marks[b] -= 1
        self.in_base = np.cumsum(marks)[:n] > 0
        sums = np.concatenate(([0], np.cumsum(self.in_base)))
        self.touched = sums[self.ends] - sums[self.starts] > 0
        digits = np.concatenate(([0], np.cumsum((self.data >= 48) & (self.data < 58))))
        self.with_digit = digits[self.ends] - digits[self.starts] > 0

    def pairs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each character of the chosen runs, the pair with the one before it; and where runs begin."""
        starts, sizes = self.starts[chosen], (self.ends - self.starts)[chosen]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(starts - begin, sizes)
        before = self.codes[at - 1].astype(np.int64)  # the very first is replaced
        before[begin] = N - 1
        return before * N + self.codes[at], begin


def _order(span: tuple[str, int, int]):
    return span[1], KINDS.index(span[0]), span[2]


def _counts(batches):
    total = np.zeros((2, N * N), np.int64)
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            scan = Scan(batch.column("text"))
            sizes = scan.ends - scan.starts
            plain = (sizes < MIN_RUN) | ~scan.with_digit
            chosen = ((sizes >= MIN_ORDINARY) & plain & ~scan.touched, (sizes >= MIN_VALUE) & scan.touched)
            for k, runs_of in enumerate(chosen):
                total[k] += np.bincount(scan.pairs(runs_of)[0], minlength=N * N)
    model, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(model, pa.int64()), pa.array(pair, pa.int64()), pa.array(total[model, pair])], ["model", "pair", "n"]
    )


def train(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random over ordinary."""
    texts = short_batches(df).select(F.col(text).alias("text"))
    counted = texts.mapInArrow(_counts, "model bigint, pair bigint, n bigint")
    total = np.zeros((2, N, N))
    for row in counted.groupBy("model", "pair").agg(F.sum("n").alias("n")).collect():  # at most 2 * N * N
        total[row["model"], row["pair"] // N, row["pair"] % N] += row["n"]
    return ratios(total)


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of the pairs from both models' counts.

    A character's share in the whole model, with add-one, weighs as N observations after each character.
    """
    single = counts.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    share = (counts + N * single) / (counts.sum(axis=2, keepdims=True) + N)
    return (np.log(share[1]) - np.log(share[0])).ravel()


def find(texts: pa.Array, ratios: np.ndarray, min_ratio: float) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by start, then kind; code points, end exclusive."""
    scan = Scan(texts)
    spans = [list(x) for x in scan.base]
    chosen = np.flatnonzero((scan.ends - scan.starts >= MIN_RUN) & ~scan.touched)
    if len(chosen):
        pairs, begin = scan.pairs(chosen)
        secret = chosen[np.add.reduceat(ratios[pairs], begin) >= min_ratio]
        owner = np.searchsorted(scan.offsets, scan.starts[secret], "right") - 1
        for k, row in zip(secret.tolist(), owner.tolist(), strict=True):
            lead = scan.data[scan.offsets[row] : scan.starts[k]]
            start = int(((lead & 0xC0) != 0x80).sum())
            spans[row].append(("random", start, start + int(scan.ends[k] - scan.starts[k])))
        for row in set(owner.tolist()):
            spans[row].sort(key=_order)
    return spans


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, spans (kind, start, end) of each row."""
    ratios = train(df, text)

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = [
                    [{"kind": k, "start": a, "end": b} for k, a, b in row]
                    for row in find(batch.column("text"), ratios, min_ratio)
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPAN)], ["doc_id", "spans"])

    picked = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(rows, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")
