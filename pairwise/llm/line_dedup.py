"""Removal of lines that many documents share.

Each document sends one row for each of its distinct line keys: a 128-bit hash, the document, and the
places of the line. The rows are range-partitioned by hash and document and sorted by hash, document
(largest first) and place, so a stream over a partition meets the document that keeps the line first.
What comes back is a compressed bitmap per document of the lines that go, not text.

Since the document is part of the range, a line that stands in a third of all documents spreads over many
partitions. The first and last hash of a partition may go on in its neighbours: such rows are left open,
with one summary row for each, at most two per partition; these are added up and settle what is open.

Line key: the line without white space at its ends, A-Z lower-cased. Lines whose key has at least
``min_chars`` code points and stands in at least ``min_docs`` documents go, except in the largest id.
Null text is one empty line. Documents are told apart by id: rows of one id count once, and if it is the
largest id, all of them keep the line. A null id counts as one document, below all others. Repeated rows
are treated alike. Columns other than id and text are passed on.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pairwise.llm.arrow_text import SLICE, extended, short_batches, slices, without
from pairwise.session import stage

MIN_CHARS = 40
MIN_DOCS = 5
NO_ID = -(1 << 63)
ENDS = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_LINES = "h1 bigint, h2 bigint, doc bigint, body bigint, places binary"
_STREAM = "state int, h1 bigint, h2 bigint, doc bigint, body bigint, places binary, n_docs bigint"
DROP, OPEN, SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(ENDS).translate(LOWER)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _line_rows(least: int):
    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                out = [[], [], [], [], []]
                cells = zip(*(batch.column(c).to_pylist() for c in ("doc", "body", "text")), strict=True)
                for doc, body, text in cells:
                    places = {}
                    for place, line in enumerate((text or "").encode().split(b"\n")):
                        if _long_enough(key := line_key(line), least):
                            places.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
                    for digest, at in places.items():
                        high, low = np.frombuffer(digest, "<i8").tolist()
                        row = (high, low, doc, body, np.array(at, "<i4").tobytes())
                        for column, cell in zip(out, row, strict=True):
                            column.append(cell)
                kinds = (pa.int64(),) * 4 + (pa.binary(),)
                arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc", "body", "places"])

    return rows


def _first_occurrences(least: int):
    """Streams a sorted partition. Holds the rows of fewer than ``least`` documents of one hash."""

    def rows(batches):
        head = None  # the partition's first hash
        now, largest, last, docs = None, None, None, 0
        held, out = [], []

        def summary():
            return (SUMMARY, *now, largest, None, None, docs)

        def flush(final: bool):
            nonlocal out
            if out and (final or len(out) >= 8192):
                kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64())
                names = ["state", "h1", "h2", "doc", "body", "places", "n_docs"]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                out = []
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for h1, h2, doc, body, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != now:
                    if now is not None and now == head:
                        out.append(summary())
                    now, largest, last, docs, held = (h1, h2), doc, doc, 1, []
                    head = head or now
                elif doc != last:
                    last, docs = doc, docs + 1
                row = (h1, h2, doc, body, places, None)
                if now == head:
                    out.append((OPEN, *row))
                elif doc != largest:
                    if docs < least:
                        held.append(row)
                    else:
                        out += [(DROP, *x) for x in held] + [(DROP, *row)]
                        held = []
            yield from flush(final=False)
        if now is not None:
            out += [(OPEN, *x) for x in held] + [summary()]
        yield from flush(final=True)

    return rows


def _bitmap(places: list[bytes]) -> bytes:
    at = np.frombuffer(b"".join(places), "<i4")
    bits = np.zeros(int(at.max()) + 1, bool)
    bits[at] = True
    return zlib.compress(np.packbits(bits).tobytes())


def _bitmaps(batches):
    for batch in batches:
        made = [_bitmap(x) for x in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("body"), pa.array(made, pa.binary())], ["doc", "body", "dropped"]
        )


def _keyed(df: DataFrame, key: str, text: str) -> tuple[F.Column, F.Column]:
    """A document is known by its id and a hash of its text."""
    return F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def drop_bitmaps(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """doc, body, dropped: the compressed bitmap of lines to drop, for documents that lose any.

    ``doc`` is the id (the least long for a null id), ``body`` the hash of the text. Lines after the
    bitmap's end are kept.
    """
    doc, body = _keyed(df, key, text)
    texts = short_batches(df).select(doc.alias("doc"), body.alias("body"), F.col(text).alias("text"))
    lines = stage(texts.mapInArrow(_line_rows(min_chars), _LINES), "lines")
    ranged = lines.repartitionByRange("h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "body")
    streamed = stage(ranged.mapInArrow(_first_occurrences(min_docs), _STREAM), "first-lines")
    drops = streamed.filter(F.col("state") == DROP)
    # at most two rows for each partition
    totals = (
        streamed.filter(F.col("state") == SUMMARY)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("total"), F.max("doc").alias("largest"))
        .filter(F.col("total") >= min_docs)
    )
    settled = (
        streamed.filter(F.col("state") == OPEN)
        .join(F.broadcast(totals), ["h1", "h2"])
        .filter(F.col("doc") != F.col("largest"))
    )
    places = drops.select("doc", "body", "places").unionByName(settled.select("doc", "body", "places"))
    gathered = places.groupBy("doc", "body").agg(F.collect_set("places").alias("places"))
    return gathered.mapInArrow(_bitmaps, "doc bigint, body bigint, dropped binary")


def _kept(text: str | None, dropped: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if dropped is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))[: len(lines)]
    gone = np.zeros(len(lines), bool)
    gone[: len(bits)] = bits
    return "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def dedup_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """All columns, with the text after removal, and n_lines (before) and n_dropped."""
    df = without(df, "n_lines", "n_dropped")
    names = df.columns
    doc, body = _keyed(df, key, text)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), doc.alias("doc"), body.alias("body"))
    bitmaps = drop_bitmaps(df, key, text, min_chars, min_docs)
    # the bitmaps are the small side of a partition; texts need not be sorted
    joined = whole.join(bitmaps.hint("shuffle_hash"), ["doc", "body"], "left").select("row.*", "dropped")
    place = names.index(text)

    def rows(batches):
        for large in batches:
            for batch in slices(large, text, SLICE):
                made = [
                    _kept(x, d)
                    for x, d in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
                ]
                columns = batch.columns[:-1]
                columns[place] = pa.array([m[0] for m in made], pa.string())
                columns += [pa.array([m[k] for m in made], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

    counts = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    return joined.mapInArrow(rows, extended(df, *counts))
