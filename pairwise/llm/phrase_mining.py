"""Phrase collocations by Rabin-Karp fingerprints.

1. Texts are lower-cased (A-Z), cut into pieces, and packed in scan order into blocks of some MB of one
   language; the blocks are written to the shared folder.
2. A block hashes every phrase of one and two words from one prefix polynomial, counts equal hashes, and
   sends its distinct hashes with their counts, sorted and cut by hash range, to buckets. A hash's place in
   the block's sorted list is the pointer to its occurrences.
3. A bucket adds the counts and answers each block with one bit a hash: frequent or not. A longer phrase is
   frequent only if all its pairs of neighbours are, so the block sends only such phrases of three to five
   words, the same way.
4. The block follows the pointers of frequent hashes to its text, checks that all occurrences of a hash are
   the same words (those that are not are counted on their own), and materialises these phrases only. They
   go to the buckets of their hashes, one compressed list for each block and bucket, where the counts are
   added by language and phrase text. So results never depend on a hash; it decides only which phrases are
   spelled out, and where they meet.
5. Scores are joins of the frequent phrases with their parts, in exact decimal arithmetic.

A hash crosses the network once per block, however often it occurs, so a phrase that stands in every
document costs no more than any other; no task gathers a phrase or a language. A block and a bucket have
bounded sizes, their numbers follow from the bytes of text. A phrase that is frequent has frequent parts,
so each part of a candidate is among the counted.

Null text is empty; null language is ``und``; empty tables give no rows. Repeated rows count each time. Only
``lang`` and ``text`` are read. A long text is cut into several blocks between pieces; a single piece
is handled by one task. Counts must stay below 10 ** 17 (then 1000 * a * n fits 38 digits).
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairwise.llm.arrow_text import encode_runs, hashes, runs
from pairwise.llm.packed_hashes import Polynomial, bounds, packed, unpacked
from pairwise.session import stage

MIN_COUNT = 100
TOP = 2000
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20  # of text; about two million hashes
HELD_BYTES = 64 << 20  # of text that a task packs at a time, over all languages
LEAST = 64  # buckets at least
PARTITION_BYTES = 64 << 20  # of text for each partition of a shuffle

ROUNDS = ((1, 2), (3, 4, 5))  # numbers of words that are hashed together; pairs come first
CODEC = "zstd"
_BREAK, _SPACE = 0x0A, 0x20
_FOLD = bytearray(range(256))
_FOLD[0x41:0x5B] = range(0x61, 0x7B)
for _byte in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_byte] = _BREAK
_FOLD[0x09] = _SPACE
_FOLD = bytes(_FOLD)

_BLOCK = "block bigint, lang string, size bigint, body binary"
_SENT = "block bigint, bucket bigint, hashes binary, counts binary"
_ANSWER = "block bigint, bucket bigint, frequent binary"
_LISTED = "bucket bigint, phrases binary"
_COUNTED = "lang string, size int, phrase string, f bigint"


def _cut(body: bytes, limit: int):
    """Parts of about limit bytes, cut between pieces."""
    at = 0
    while len(body) - at > limit:
        end = body.rfind(b"\n", at, at + limit) + 1
        if end <= at:
            end = body.find(b"\n", at + limit) + 1 or len(body)
        yield body[at:end]
        at = end
    yield body[at:]


def _packer(block_bytes: int):
    """Rows of (lang, text) to blocks. The number of a block is its task's and a counter."""

    def pack(batches):
        first, made = TaskContext.get().partitionId() << 33, 0
        held, size = defaultdict(list), defaultdict(int)

        def block(lang):
            nonlocal made
            made += 1
            body = b"\n".join(held.pop(lang))
            size.pop(lang)
            columns = [
                pa.array([first + made], pa.int64()), pa.array([lang], pa.string()), pa.array([len(body)], pa.int64()),
                pa.array([pa.compress(body, CODEC, asbytes=True)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "lang", "size", "body"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _cut((text or "").encode().translate(_FOLD), block_bytes):
                    held[lang].append(part)
                    size[lang] += len(part) + 1
                    if size[lang] >= block_bytes:
                        yield block(lang)
            if sum(size.values()) > HELD_BYTES:
                for lang in list(held):
                    yield block(lang)
        for lang in list(held):
            yield block(lang)

    return pack


class Phrases:
    """The words of a block, and where its phrases of each size start and how they hash."""

    def __init__(self, body: bytes, lang: str):
        data = np.frombuffer(body, np.uint8)
        inside = (data != _SPACE) & (data != _BREAK)
        starts, ends = runs(inside, np.array([0, len(data)]))
        self.codes, self.vocabulary = encode_runs(data, starts, ends, inside)
        self.piece = np.searchsorted(np.flatnonzero(data == _BREAK), starts).astype(np.int32)
        self.n_words, self.lang = len(starts), lang
        self.rolled = Polynomial(hashes(self.vocabulary)[self.codes] if len(starts) else np.zeros(0, np.uint64))
        self.pairs: np.ndarray | None = None  # where a frequent pair starts, once that is known

    def of_size(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the phrases of so many words; of more than two, only those of frequent pairs."""
        last = self.n_words - size + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.piece[size - 1 :] == self.piece[:last]
        if size > 2 and self.pairs is not None:
            for k in range(size - 1):
                inside &= self.pairs[k : k + last]
        begin = np.flatnonzero(inside)
        return begin, self.rolled.of(begin, size, xxhash.xxh3_64_intdigest(self.lang.encode(), size))

    def distinct(self, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all phrases of these sizes, and their counts."""
        found = np.concatenate([self.of_size(size)[1] for size in sizes])
        found.sort()
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        return found[first], np.diff(first, append=len(found))

    def keep_pairs(self, chosen: np.ndarray):
        begin, found = self.of_size(2)
        self.pairs = np.zeros(self.n_words, bool)
        self.pairs[begin[_among(found, chosen)[0]]] = True

    def spelled(self, begin: np.ndarray, size: int) -> pa.Array:
        words = [self.vocabulary.take(pa.array(self.codes[begin + k])).cast(pa.binary()) for k in range(size)]
        return (pc.binary_join_element_wise(*words, b" ") if size > 1 else words[0]).cast(pa.string())

    def frequent(self, chosen: np.ndarray, sizes: tuple[int, ...]):
        """size, hashes, phrases and counts of the chosen hashes (sorted), by their text."""
        for size in sizes:
            begin, found = self.of_size(size)
            own, of = _among(found, chosen)
            if not len(own):
                continue
            begin = begin[own]
            _, first, group, counts = np.unique(of, return_index=True, return_inverse=True, return_counts=True)
            pointed = begin[first]
            same = np.ones(len(own), bool)
            for k in range(size):
                same &= self.codes[begin + k] == self.codes[pointed[group] + k]
            yield size, chosen[of[first]], self.spelled(pointed, size), np.bincount(group[same], minlength=len(counts))
            if not same.all():  # other words of the same hash
                yield size, chosen[of[~same]], self.spelled(begin[~same], size), np.ones(np.count_nonzero(~same), np.int64)


def _among(found: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the found stand in the chosen (sorted), and where there."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(chosen, found)
    own = np.flatnonzero(chosen[np.minimum(at, len(chosen) - 1)] == found)
    return own, at[own]


def _lists(phrases: Phrases, block: int, sizes: tuple[int, ...], buckets: int, min_count: int) -> pa.RecordBatch:
    """What a block sends of its phrases of these sizes."""
    distinct, counts = phrases.distinct(sizes)
    counts = np.minimum(counts, min_count).astype(_kind(min_count))  # more than enough is enough
    cuts = bounds(distinct, buckets)
    filled = np.flatnonzero(np.diff(cuts))
    columns = [
        pa.array(np.full(len(filled), block), pa.int64()),
        pa.array(filled, pa.int64()),
        pa.array([packed(distinct[cuts[k] : cuts[k + 1]]) for k in filled], pa.binary()),
        pa.array([counts[cuts[k] : cuts[k + 1]].tobytes() for k in filled], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "hashes", "counts"])


def _kind(min_count: int) -> str:
    return "<u1" if min_count < 256 else "<u4"


def _bodies(table: pa.Table | pa.RecordBatch):
    """block, phrases of each row."""
    columns = [table.column(k).to_pylist() for k in ("block", "lang", "size", "body")]
    for block, lang, size, body in zip(*columns, strict=True):
        yield block, Phrases(pa.decompress(body, size, CODEC, asbytes=True), lang)


def _first_sender(buckets: int, min_count: int):
    def send(batches):
        for batch in batches:
            for block, phrases in _bodies(batch):
                yield _lists(phrases, block, ROUNDS[0], buckets, min_count)

    return send


def _chosen(phrases: Phrases, sizes: tuple[int, ...], answers: pa.Table, turn: int, buckets: int) -> np.ndarray:
    """Hashes of these sizes that the answers of a turn call frequent."""
    distinct, _ = phrases.distinct(sizes)
    cuts = bounds(distinct, buckets)
    chosen = np.zeros(len(distinct), bool)
    for of, k, bits in zip(*(answers.column(c).to_pylist() for c in ("turn", "bucket", "frequent")), strict=True):
        if of == turn:
            part = chosen[cuts[k] : cuts[k + 1]]
            part |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)
    return distinct[chosen]


def _second_sender(buckets: int, min_count: int):
    def send(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [_lists(Phrases(b"", ""), 0, ROUNDS[1], buckets, min_count)]
        for block, phrases in _bodies(blocks):
            phrases.keep_pairs(_chosen(phrases, ROUNDS[0], answers, 1, buckets))
            parts.append(_lists(phrases, block, ROUNDS[1], buckets, min_count))
        return pa.Table.from_batches(parts)

    return send


def _counter(min_count: int):
    def count(table: pa.Table) -> pa.Table:
        lists = [unpacked(x) for x in table.column("hashes").to_pylist()]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), _kind(min_count))
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct))
        answers = np.split((totals >= min_count)[inverse], np.cumsum([len(x) for x in lists])[:-1])
        bits = pa.array([np.packbits(x).tobytes() for x in answers], pa.binary())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "frequent": bits})

    return count


def _teller(buckets: int):
    """Counts of a block's frequent phrases, and of all its words (size 0), as a list for each bucket."""

    def tell(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for _, phrases in _bodies(blocks):
            parts = [_told(phrases.lang, 0, np.zeros(1, np.uint64), pa.array([""]), [phrases.n_words])]
            for turn, sizes in enumerate(ROUNDS, 1):
                chosen = _chosen(phrases, sizes, answers, turn, buckets)
                parts += [_told(phrases.lang, *x) for x in phrases.frequent(chosen, sizes)]
                if turn == 1:
                    phrases.keep_pairs(chosen)
            told = pa.concat_tables(parts).sort_by("hash").combine_chunks()
            cuts = bounds(told.column("hash").to_numpy(), buckets)
            lists = told.select(["lang", "size", "phrase", "f"])
            out += [(int(k), _written(lists.slice(cuts[k], cuts[k + 1] - cuts[k]))) for k in np.flatnonzero(np.diff(cuts))]
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"bucket": pa.array(columns[0], pa.int64()), "phrases": pa.array(columns[1], pa.binary())})

    return tell


def _told(lang: str, size: int, found: np.ndarray, phrases: pa.Array, counts) -> pa.Table:
    n = len(phrases)
    langs, sizes = pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32())
    return pa.table({"lang": langs, "size": sizes, "phrase": phrases, "f": pa.array(counts, pa.int64()), "hash": pa.array(found)})


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _adder(min_count: int):
    """Sums of a bucket's lists by text; of phrases, those that are frequent."""

    def add(lists: pa.Table) -> pa.Table:
        whole = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in lists.column("phrases").to_pylist()])
        summed = whole.group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        kept = pc.or_(pc.greater_equal(summed["f"], min_count), pc.equal(summed["size"], 0))
        return summed.filter(kept).select(["lang", "size", "phrase", "f"])

    return add


def count_phrases(
    df: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """lang, size, phrase, f: every phrase of up to five words found ``min_count`` times, and at size 0 all words."""
    spark = df.sparkSession
    picked = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = stage(picked.mapInArrow(_packer(block_bytes), _BLOCK), "phrase-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST, -(-total // bucket_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))

    def answered(sent: DataFrame, turn: int) -> DataFrame:
        counted = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_counter(min_count), _ANSWER)
        return stage(counted.withColumn("turn", F.lit(turn)), "phrase-answers")

    def at_blocks(answers: DataFrame, function, schema: str) -> DataFrame:
        texts, bits = blocks.repartition(parts, "block"), answers.repartition(parts, "block")
        return texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(function, schema)

    first = answered(blocks.mapInArrow(_first_sender(buckets, min_count), _SENT), 1)
    second = answered(at_blocks(first, _second_sender(buckets, min_count), _SENT), 2)
    told = at_blocks(first.unionByName(second), _teller(buckets), _LISTED)
    counted = told.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_adder(min_count), _COUNTED)
    return stage(counted, "phrase-counts")


def _parts(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def score_phrases(counted: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score, covered for each candidate of two or more words."""
    exact = "decimal(38,0)"
    words = counted.filter("size = 0").select("lang", F.col("f").alias("n"))
    known = counted.filter("size > 0").select("lang", "phrase", "f")
    found = counted.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    split = F.split("phrase", " ")
    cuts = found.select(
        "*",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("size") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    _parts(split, F.lit(1), k).alias("left"),
                    _parts(split, k + 1, F.col("size") - k).alias("right"),
                ),
            )
        ).alias("cut"),
    ).select("lang", "phrase", "size", "a", "cut.*")
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    joined = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(words, "lang")
    product = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)")
    parts = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    scored = joined.withColumn("product", product.cast(exact)).withColumn("parts", parts.cast(exact))
    rank = F.struct(F.expr("product div parts").alias("score"), "k", "l", "r")
    best = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(rank).alias("best"))
    inner = found.filter("size > 2").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("size") - 1),
                    lambda s: F.transform(
                        F.sequence(F.lit(1), F.col("size") - s + 1), lambda at: _parts(split, at, s)
                    ),
                )
            )
        ).alias("phrase"),
    )
    longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= 100 * F.col("a"), F.lit(False))
    return best.join(longest, ["lang", "phrase"], "left").select(
        "lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score", covered.alias("covered")
    )


def collocations(
    df: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    **sizes: int,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    scored = score_phrases(count_phrases(df, lang, text, min_count, **sizes)).filter(~F.col("covered"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
