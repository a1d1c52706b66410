"""Benchmark decontamination with suffix arrays over the training documents.

Documents are cut into shards of about 16 MB as they are read; no text is shuffled. Each shard sorts its
suffixes (by words, as deep as a window) and every test suffix that is long enough to hold a window is
found in it by binary search: equal windows of the items share one search, and most end at the first few
words. At the places found, where the words before differ, a match begins; it is followed to the right as
far as the words agree, which gives all maximal verbatim matches, with their places.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
Suffixes that cannot hold a window are left out of the array: all words of a match are words of test
items, so those with too few such words ahead are no candidates. This loses no match. Words are compared
by themselves, not by hashes.

The test items are the query set. Up to ``block_bytes`` of test text go to the tasks at once and the
documents are read once. A larger set is searched block by block: each block is a pass over the documents
that writes the matches of the few documents that have any, under a digest of their text, and its
broadcast is destroyed before the next begins; at the end the matches are joined back.

Null texts have no words. Items without an id mark words, but are not listed; rows of one item id count as
one item. Repeated documents are judged row by row. A very long text is one shard: about 100 bytes for
each of its words, in one task. Empty documents give an empty table, an empty benchmark marks nothing.
Columns of the documents are passed on; those that bear the name of a result column are replaced.
"""

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pairwise.llm.arrow_text import ALPHANUMERIC, extended, short_batches, slices, split_words, without
from pairwise.session import stage

WINDOW = 10
BLOCK_BYTES = 8 << 20  # of test text in one pass
SHARD = 16 << 20  # bytes of documents under one suffix array
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STEP = 16  # words compared at a time beyond a window
PAIRS = 1 << 17  # places compared at a time

MATCH = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]
)
PLACE = T.StructType([*MATCH.fields, T.StructField("item_word", T.IntegerType())])
HITS = T.StructField("hits", T.ArrayType(T.IntegerType()))  # starts and ends, by turns
ITEMS = T.StructField("items", T.ArrayType(T.LongType()))
MATCHES = T.StructField("matches", T.ArrayType(MATCH))  # the longest for each item
PLACES = T.StructField("places", T.ArrayType(PLACE))  # all maximal ones
FIELDS = (T.StructField("n_words", T.LongType()), HITS, ITEMS, MATCHES, PLACES)
_MATCH = pa.struct([("item_id", pa.int64()), ("word", pa.int32()), ("n_words", pa.int32())])
_PLACE = pa.struct([*_MATCH, ("item_word", pa.int32())])
KINDS = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(_MATCH), pa.list_(_PLACE))


class Tests(NamedTuple):
    """Test items as one sequence of word numbers (from 1; a 0 stands before and after each item)."""

    vocabulary: list[bytes]
    words: np.ndarray
    width: np.ndarray  # of each distinct window, in the order of their words
    low: np.ndarray  # least and greatest packed words that begin with the window: a row for each pack
    high: np.ndarray
    first: np.ndarray  # distinct window k stands at starts[first[k]:first[k + 1]]
    starts: np.ndarray
    begin: np.ndarray  # of each item in words
    item_ids: list
    depth: int
    least: int


def pack_size(radix: int) -> int:
    """Words, as numbers below ``radix``, that fit into one integer."""
    return max(1, int(62 / np.log2(radix)))


def prepare(item_ids: list, texts: pa.Array, window: int) -> Tests:
    split = split_words(texts, ALPHANUMERIC)
    sizes = np.diff(split.first)
    words = np.zeros(len(split.codes) + len(sizes) + 1 + STEP + window + 64, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    words[np.arange(len(split.codes)) + owner + 1] = split.codes + 1
    begin = split.first[:-1] + np.arange(len(sizes)) + 1
    counts = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
    item = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[item]
    width = np.minimum(sizes, window)[item]
    depth = int(width.max(initial=0))
    radix = len(split.vocabulary) + 2
    step = pack_size(radix)
    low, high = [], []
    for offset in range(0, depth, step):
        least, most = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for k in range(offset, offset + step):
            inside = k < np.minimum(width, depth)
            word = words[start + k]
            least = least * radix + np.where(inside, word, 0)
            most = most * radix + np.where(inside, word, radix - 1)
        low.append(least)
        high.append(most)
    if not depth:
        none = np.zeros(0, np.int64)
        return Tests([], words, none, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(1, np.int64), none, begin, item_ids, 0, 0)
    by = np.lexsort((width, *low[::-1]))
    low, high, width, start = np.array(low)[:, by], np.array(high)[:, by], width[by], start[by]
    new = np.ones(len(by), bool)
    new[1:] = (low[:, 1:] != low[:, :-1]).any(0) | (width[1:] != width[:-1])
    at = np.flatnonzero(new)
    vocabulary = split.vocabulary.to_pylist()
    first = np.append(at, len(by))
    return Tests(vocabulary, words, width[at], low[:, at], high[:, at], first, start, begin, item_ids, depth, int(width.min()))


def packed(sequence: np.ndarray, at: np.ndarray, offset: int, step: int, radix: int) -> np.ndarray:
    """The ``step`` words from at + offset on as one number."""
    key = np.zeros(len(at), np.int64)
    for k in range(offset, offset + step):
        key = key * radix + sequence[at + k]
    return key


def suffix_array(sequence: np.ndarray, starts: np.ndarray, depth: int, radix: int | None = None) -> np.ndarray:
    """``starts`` ordered by the words that follow, up to ``depth``.

    Sorts by as many words as fit into one number, then, where that leaves ties, by the next ones.
    """
    radix = radix or int(sequence.max(initial=0)) + 2
    step = pack_size(radix)
    first = packed(sequence, starts, 0, step, radix)
    order = starts[np.argsort(first, kind="stable")]
    first.sort()
    group = np.concatenate(([0], np.cumsum(first[1:] != first[:-1]))) if len(order) else first
    for offset in range(step, depth, step):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        more = packed(sequence, order[at], offset, step, radix)
        by = np.lexsort((more, group[at]))
        order[at] = order[at][by]
        more, held = more[by], group[at]
        split = np.zeros(len(order), np.int64)
        split[at[1:]] = (held[1:] == held[:-1]) & (more[1:] != more[:-1])
        group = group + np.cumsum(split)
    return order


def find(sequence: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct test window the range of the suffix array that begins with it."""
    radix = len(tests.vocabulary) + 2
    step = pack_size(radix)
    keys = packed(sequence, order, 0, step, radix)
    low = np.searchsorted(keys, tests.low[0], "left")
    high = np.searchsorted(keys, tests.high[0], "right")
    for level, offset in enumerate(range(step, tests.depth, step), 1):
        live = np.flatnonzero((low < high) & (offset < tests.width))
        if not len(live):
            break
        ends = []
        for bound, strict in ((tests.low[level][live], False), (tests.high[level][live], True)):
            a, b = low[live], high[live]
            while (open_ := a < b).any():
                middle = (a + b) // 2
                seen = packed(sequence, order[np.minimum(middle, len(order) - 1)], offset, step, radix)
                right = open_ & ((seen <= bound) if strict else (seen < bound))
                a, b = np.where(right, middle + 1, a), np.where(open_ & ~right, middle, b)
            ends.append(a)
        low[live], high[live] = ends
    return low, high


def follow(words: np.ndarray, i: np.ndarray, sequence: np.ndarray, p: np.ndarray, size: np.ndarray) -> None:
    """Grow ``size`` to the number of words on which words[i:] and sequence[p:] agree."""
    for part in range(0, len(i), PAIRS):
        live = np.arange(part, min(part + PAIRS, len(i)))
        while len(live):
            ahead = size[live][:, None] + np.arange(STEP)
            a, b = words[i[live][:, None] + ahead], sequence[p[live][:, None] + ahead]
            same = (a == b) & (a > 0)
            run = np.where(same.all(1), STEP, same.argmin(1))
            size[live] += run
            live = live[run == STEP]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (n[k] numbers) for all k."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _shard(texts: pa.Array, tests: Tests, ranks: dict[bytes, int], places: bool):
    """n_words, hit intervals, items, longest matches and, if asked for, all maximal matches of each text."""
    split = split_words(texts, ALPHANUMERIC)
    rows = len(texts)
    sizes = np.diff(split.first)
    other = len(tests.vocabulary) + 1  # words that no item has never match
    known = np.fromiter((ranks.get(w, other) for w in split.vocabulary.to_pylist()), np.int64, len(split.vocabulary))
    owner = np.repeat(np.arange(rows), sizes)
    sequence = np.zeros(len(split.codes) + rows + tests.depth + STEP + 64, np.int64)
    sequence[np.arange(len(split.codes)) + owner] = known[split.codes]
    begin = split.first[:-1] + np.arange(rows)
    hits, items, matches, every = ([[] for _ in range(rows)] for _ in range(4))
    usable = (sequence > 0) & (sequence < other)
    if not tests.depth or not usable.any():
        return sizes, hits, items, matches, every
    stop = np.where(usable, len(sequence), np.arange(len(sequence)))
    ahead = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(sequence))
    order = suffix_array(sequence, np.flatnonzero(ahead >= tests.least), tests.depth, len(tests.vocabulary) + 2)
    low, high = find(sequence, order, tests)
    n = np.maximum(high - low, 0)
    found = np.flatnonzero(n)
    if not len(found):
        return sizes, hits, items, matches, every
    window = np.repeat(found, n[found])
    at = order[_ranges(low[found], n[found])]
    size = len(sequence) + 1
    cover = np.bincount(at, minlength=size) - np.bincount(at + tests.width[window], minlength=size)
    marked = np.concatenate(([False], np.cumsum(cover)[: len(sequence)] > 0))
    turns = np.flatnonzero(marked[1:] != marked[:-1])
    for a, b in turns.reshape(-1, 2).tolist():  # spans end at a separator at the latest
        row = int(np.searchsorted(begin, a, "right")) - 1
        hits[row] += [a - int(begin[row]), b - int(begin[row])]
    # a match begins where the words before differ, or at the start of the item
    uses = np.diff(tests.first)[window]
    i, p = tests.starts[_ranges(tests.first[window], uses)], np.repeat(at, uses)
    width = np.repeat(tests.width[window], uses)
    before = np.where(p > 0, sequence[p - 1], 0)
    head = (tests.words[i - 1] == 0) | (tests.words[i - 1] != before)
    i, p, length = i[head], p[head], width[head].copy()
    follow(tests.words, i, sequence, p, length)
    item, doc = np.searchsorted(tests.begin, i, "right") - 1, np.searchsorted(begin, p, "right") - 1
    by = np.lexsort((i, p, -length, item, doc))
    i, p, length, item, doc = i[by], p[by], length[by], item[by], doc[by]
    longest = np.ones(len(by), bool)
    longest[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    if not places:
        i, p, length, item, doc, longest = (x[longest] for x in (i, p, length, item, doc, longest))
    columns = (doc, item, p - begin[doc], length, i - tests.begin[item], longest)
    for row, k, word, count, item_word, best in zip(*(x.tolist() for x in columns), strict=True):
        if (name := tests.item_ids[k]) is None:
            continue
        match = {"item_id": name, "word": word, "n_words": count}
        if best:
            items[row].append(name)
            matches[row].append(match)
        if places:
            every[row].append(match | {"item_word": item_word})
    return sizes, hits, items, matches, every


def _union(old: list[int], new: list[int]) -> list[int]:
    """Intervals of two passes as disjoint ones in order."""
    out: list[int] = []
    for a, b in sorted([*zip(old[::2], old[1::2], strict=True), *zip(new[::2], new[1::2], strict=True)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _best(old: list[dict], new: list[dict]) -> list[dict]:
    best: dict[int, dict] = {}
    for m in [*old, *new]:
        if m["item_id"] not in best or m["n_words"] > best[m["item_id"]]["n_words"]:
            best[m["item_id"]] = m
    return [best[k] for k in sorted(best)]


def _sorted_places(places: list[dict]) -> list[dict]:
    return sorted(places, key=lambda m: (m["word"], m["item_id"], m["item_word"]))


def _shards(batches, text: str):
    """Batches put together, or cut, so that they hold about SHARD bytes of text."""
    held, size = [], 0
    for large in batches:
        for batch in slices(large, text, SHARD):
            if size and size + batch.nbytes > SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _fields(places: bool) -> tuple[T.StructField, ...]:
    return FIELDS if places else FIELDS[:-1]


def _search(tests, text: str, drop: list[str], places: bool, hit_only: bool):
    """Adds the results to each row; ``hit_only`` leaves out rows without a hit, and n_words."""
    names = [f.name for f in _fields(places)[int(hit_only) :]]

    def rows(batches):
        ranks = {word: k for k, word in enumerate(tests.value.vocabulary, 1)}  # once a task
        for batch in _shards(batches, text):
            sizes, hits, items, matches, every = _shard(batch.column(text), tests.value, ranks, places)
            items = [sorted(set(x)) for x in items]
            matches = [_best([], x) for x in matches]
            every = [_sorted_places(x) for x in every]
            made = [pa.array(c, k) for c, k in zip((hits, items, matches, every), KINDS, strict=True)]
            made = made if places else made[:-1]
            if not hit_only:
                made = [pa.array(sizes, pa.int64()), *made]
            carried = [c for c in batch.schema.names if c not in drop]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *made], [*carried, *names])
            yield out.filter(pa.array([bool(h) for h in hits], pa.bool_())) if hit_only else out

    return rows


def _merge(places: bool):
    """One row for each text from the rows that the blocks of test items gave it."""
    names = [f.name for f in _fields(places)[1:]]

    def rows(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                hits, matches = [], []
                for part in parts:
                    hits, matches = _union(hits, part["hits"]), _best(matches, part["matches"])
                items = sorted({k for part in parts for k in part["items"]})
                every = _sorted_places([m for part in parts for m in part.get("places", [])])
                out.append((hits, items, matches, every))
            made = [pa.array([row[c] for row in out], KINDS[c]) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *made], ["_key", *names])

    return rows


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
    places: bool = False,
) -> DataFrame:
    """All columns and n_words, hits (intervals of words), items, matches (the longest for each item).

    ``places`` adds all maximal matches, with the word of the document and of the item where each begins.
    ``keep_text`` False drops the text.
    """
    spark = df.sparkSession
    fields = _fields(places)
    df = short_batches(without(df, *[f.name for f in fields]))
    tests = benchmark.select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(k: int):
        part = tests.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow()
        return spark.sparkContext.broadcast(prepare(part.column("id").to_pylist(), part.column("text").combine_chunks(), window))

    kept = df if keep_text else df.drop(text)
    if blocks == 1:
        search = _search(block(0), text, [] if keep_text else [text], places, hit_only=False)
        return df.mapInArrow(search, extended(kept, *fields))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.md5(body.cast("binary")).alias("_key")
    keyed = df.select(key, body.alias("_body"))
    schema = T.StructType([T.StructField("_key", T.StringType()), *fields[1:]])
    passes = []
    for k in range(blocks):
        shared = block(k)
        found = keyed.mapInArrow(_search(shared, "_body", ["_body"], places, hit_only=True), schema)
        passes.append(stage(found, "matches").withColumn("_block", F.lit(k)))
        shared.destroy()
    rows = functools.reduce(DataFrame.union, passes)
    parts = F.collect_list(F.struct(*[f.name for f in fields[1:]])).alias("parts")
    once = rows.dropDuplicates(["_key", "_block"])  # equal texts have equal matches
    merged = stage(once.groupBy("_key").agg(parts).mapInArrow(_merge(places), schema), "matches")
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept.columns)]
    n_words = F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("n_words")
    joined = df.select(*own, key, n_words).join(merged, "_key", "left")
    back = [F.col(f"own_{i}").alias(c) for i, c in enumerate(kept.columns)]
    results = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in fields[1:]]
    return joined.select(*back, "n_words", *results)


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of a test item, with their columns."""
    names = df.columns
    marked = without(df, *[f.name for f in FIELDS])
    if len(marked.columns) < len(names):  # columns that bear a result's name travel in a struct
        df = df.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in names]))
        found = find_contamination(df, benchmark, **options)
        return found.filter(F.size("hits") == 0).select("_all.*")
    return find_contamination(df, benchmark, **options).filter(F.size("hits") == 0).select(*names)
