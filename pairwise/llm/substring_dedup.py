"""Removal of repeated word windows by Rabin-Karp hashes.

1. Documents are packed in scan order into blocks of a few MB, which are written to the shared folder. A
   block rolls one 64-bit hash over each window of ``window`` words and sends its distinct hashes, sorted and
   cut by hash range, to buckets.
2. A bucket counts in how many blocks each hash stands and answers every block with one bit per hash.
3. The block forms its hashes again, marks windows that are repeated (in another block, or in its own),
   and merges them into maximal intervals of words, which are removed.

A hash crosses the network once per block, as a difference to the one before it, and comes back as one
bit, so a passage that stands in every document costs no more than any other, and rows that are equal are
spread like any others. Blocks and buckets have bounded sizes; their number, and that of the partitions,
follows from the bytes of text.

A window counts wherever it starts, so rows that repeat remove each other's windows. Null text has no
words; a null id stays null. Texts of fewer words than a window stay whole. Only the id and the text are
read. Two windows are taken as equal if their 64-bit hashes are: with N windows in the corpus, a window
is removed by chance with probability N / 2**64.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairwise.llm.arrow_text import SLICE, UNCHANGED, Words, hashes, runs, short_batches, slices, split_words
from pairwise.llm.packed_hashes import Polynomial, bounds, packed, unpacked
from pairwise.session import stage

WINDOW = 35
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20  # of text; about a million windows
LEAST = 64  # buckets at least
PARTITION_BYTES = 64 << 20  # of text for each partition of a shuffle
CODEC = "zstd"

_BLOCK = "block bigint, size bigint, body binary"
_SENT = "block bigint, bucket bigint, sent binary"
_ANSWER = "block bigint, bucket bigint, shared binary"
_RESULT = "doc_id bigint, n_words bigint, removed array<struct<start:int,end:int>>, kept_text string"


def _packer(block_bytes: int):
    """Rows (doc_id, text) in blocks, compressed. The number of a block is its task's and a counter."""

    def pack(batches):
        first, made = TaskContext.get().partitionId() << 33, 0
        held, size = [], 0

        def block():
            nonlocal made, held, size
            made += 1
            columns = [pa.array([first + made], pa.int64()), pa.array([size], pa.int64()), pa.array([_written(held)], pa.binary())]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(columns, ["block", "size", "body"])

        for whole in batches:
            for batch in slices(whole, "text", min(SLICE, block_bytes)):
                held.append(batch)
                size += batch.column("text").nbytes
                if size >= block_bytes:
                    yield block()
        if held:
            yield block()

    return pack


def _written(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as writer:
        writer.write_table(pa.Table.from_batches(batches))
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def _words_of(docs: pa.Table) -> Words:
    texts = docs.column("text").cast(pa.large_string()).combine_chunks()
    return split_words(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks), UNCHANGED)


def window_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window starts, and its hash: the sum of word hash times multiplier to the word's place."""
    n = np.maximum(np.diff(words.first) - window + 1, 0)
    begin = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    return begin, Polynomial(hashes(words.vocabulary)[words.codes]).of(begin, window, 0)


def _sender(window: int, buckets: int):
    def send(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                distinct = np.unique(window_hashes(_words_of(_read(body)), window)[1])
                cuts = bounds(distinct, buckets)
                filled = np.flatnonzero(np.diff(cuts))
                columns = [
                    pa.array(np.full(len(filled), block), pa.int64()),
                    pa.array(filled, pa.int64()),
                    pa.array([packed(distinct[cuts[k] : cuts[k + 1]]) for k in filled], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "sent"])

    return send


def _count(table: pa.Table) -> pa.Table:
    """For each block's hashes: which of them another block has sent too."""
    lists = [unpacked(x) for x in table.column("sent").to_pylist()]
    _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.split((counts > 1)[inverse], np.cumsum([len(x) for x in lists])[:-1])
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "shared": pa.array([np.packbits(x).tobytes() for x in shared], pa.binary()),
        }
    )


def _remover(window: int, buckets: int):
    def remove(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _read(blocks.column("body")[0].as_py())
        words = _words_of(docs)
        begin, own = window_hashes(words, window)
        distinct, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        cuts = bounds(distinct, buckets)
        again = counts > 1
        for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist(), strict=True):
            part = again[cuts[k] : cuts[k + 1]]
            part |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)
        hit = begin[again[inverse]]
        n = len(words.codes)
        inside = np.cumsum(np.bincount(hit, minlength=n + 1) - np.bincount(hit + window, minlength=n + 1))[:n] > 0
        starts, ends = runs(inside, words.first)
        row = np.searchsorted(words.first, starts, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(starts - words.first[row], pa.int32()), pa.array(ends - words.first[row], pa.int32())],
            ["start", "end"],
        )
        kept = words.vocabulary.take(pa.array(words.codes[~inside])).cast(pa.binary())
        before = np.concatenate(([0], np.cumsum(~inside)))[words.first]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), kept), b" ")
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "removed": pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(starts, words.first), pa.int32()), spans
                ),
                "kept_text": texts.cast(pa.string()),
            }
        )

    return remove


def remove_repeats(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_words, removed (intervals of word places) and kept_text (words joined by a space)."""
    spark = df.sparkSession
    picked = short_batches(df).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    blocks = stage(picked.mapInArrow(_packer(block_bytes), _BLOCK), "text-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST, -(-total // bucket_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    sent = blocks.mapInArrow(_sender(window, buckets), _SENT).repartition(parts, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_count, _ANSWER).repartition(parts, "block")
    dealt = blocks.repartition(parts, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remover(window, buckets), _RESULT)
