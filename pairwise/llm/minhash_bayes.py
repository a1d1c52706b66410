"""MinHash near-duplicates with sequential Bayesian verification.

1. A document is the set of its distinct 4-word shingles (64-bit hashes). Equal sets are one entry, named by
   a 128-bit digest, so copies never meet. Each entry gets a signature of ``ROWS`` x ``BANDS`` min-hashes.
2. Entries that agree on all rows of a band are candidates. A pair at the threshold agrees nowhere with
   probability (1 - 0.8 ** 4) ** 32 = 5e-8.
3. Entries that meet in a bucket, directly or over others, form a crowd. The entries' sets are formed anew
   from one text each and sent to their crowd, once. A crowd of more than ``CROWD`` entries is not followed
   as a whole: its entries meet in their buckets instead.
4. Within a crowd a pair is compared signature batch by signature batch. After n rows with m agreements its
   similarity has the posterior Beta(1 + m, 1 + n - m); the pair is dropped once the probability of 0.8 or
   more is under ``MISS``. Survivors are verified on their full sets. Entries that are linked already, over
   whatever links, are not compared any more, so a crowd returns a spanning forest of its links, at most
   one row an entry, and never its pairs.

Crowds and buckets of more than ``CHUNK`` entries or ``CHUNK_BYTES`` of sets are compared as pairs of chunks of
that size, each in a task of its own, so memory is bounded; time grows with the square of a crowd only where
its members are not linked. Buckets are found by aggregates and joins, so a hot one is split by Spark.

Words are runs of other than ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is
one shingle. Null and empty texts have no shingle and are linked with nothing. A document is a row: rows
that repeat belong to one class. ``component_id`` is the smallest id reachable; it is null, and the row
kept, in a class whose ids are all null. An empty table gives no rows. Only id and text are read. A long
text is handled by one task, its min-hashes are taken some thousand shingles at a time.
"""

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairwise.llm.arrow_text import LOWERED, SLICE, hashes, short_batches, slices, split_words
from pairwise.llm.components import components
from pairwise.llm.packed_hashes import mixed
from pairwise.session import stage

SHINGLE = 4
ROWS, BANDS = 4, 32
BATCH = 32  # rows of a signature that are compared at a time
NUMERATOR, DENOMINATOR = 80, 100  # linked: DENOMINATOR * intersection >= NUMERATOR * union
MISS = 1e-6
CROWD = 1 << 17  # entries; a crowd of so many chunks sends a set as often as its 32 buckets would
CHUNK = 4096
CHUNK_BYTES = 16 << 20
FEW = 16
_COLUMNS = 4096  # shingles that are min-hashed at a time
_PLACES = tuple(np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_SET = "doc_id bigint, body bigint, digest binary, n bigint, signature binary"


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)[:, None]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(texts, LOWERED)
    if not len(words.codes):
        return [np.zeros(0, np.uint64)] * len(texts)
    terms = hashes(words.vocabulary)[words.codes]
    n = len(terms)
    rolled = np.full(max(0, n - SHINGLE + 1), SHINGLE, np.uint64)
    for k, place in enumerate(_PLACES):
        rolled += terms[k : k + len(rolled)] * place
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:  # all words of a short text are its one shingle
            whole = np.uint64(b - a)
            for k in range(b - a):
                whole = whole + terms[a + k : a + k + 1] * _PLACES[k]
            sets.append(mixed(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles, upper 32 bits of a 64-bit product."""
    a, b = _multipliers()
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    short = shingles >> np.uint64(32)
    for k in range(0, len(short), _COLUMNS):
        np.minimum(least, ((short[None, k : k + _COLUMNS] * a + b) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype("<u4")


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest() if len(shingles) else None


def _body(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def document_sets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body (a hash of the text), digest (null: no shingle), n, signature for each row."""

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("body"),
                        pa.array(map(digest, sets), pa.binary()),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array((signature(s).tobytes() if len(s) else None for s in sets), pa.binary()),
                    ],
                    ["doc_id", "body", "digest", "n", "signature"],
                )

    picked = short_batches(df).select(
        F.col(key).cast("bigint").alias("doc_id"), _body(text).alias("body"), F.col(text).alias("text")
    )
    return picked.mapInArrow(rows, _SET)


@functools.cache
def least_matches(miss: float = MISS) -> tuple[int, ...]:
    """For each batch: agreements below which similarity 0.8 or more has a posterior probability under miss.

    P(Beta(1 + m, 1 + n - m) >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = NUMERATOR / DENOMINATOR, []
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return tuple(out)


def agreements(left: np.ndarray, right: np.ndarray, at: np.ndarray, miss: float = MISS) -> np.ndarray:
    """Agreeing rows of left (a signature, or one for each place) with right[at]; -1 where a batch has ruled the pair out."""
    matches, alive = np.zeros(len(at), np.int64), np.arange(len(at))
    for k, least in enumerate(least_matches(miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        own = left[part] if left.ndim == 1 else left[alive, part]
        matches[alive] += (right[at[alive], part] == own).sum(axis=1)
        out = matches[alive] < least
        matches[alive[out]] = -1
        alive = alive[~out]
    return matches


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, ROWS * BANDS)


def _bands(batches):
    """part (band and its rows as one hash) and sid for each band of each entry."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _signatures(batch.column("signature")).reshape(-1, BANDS, ROWS).astype(np.uint64)
        part = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
        for k in range(ROWS):
            part = mixed(part * _PLACES[0] + rows[:, :, k])
        sid = np.repeat(batch.column("sid").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(part.ravel().view(np.int64)), pa.array(sid)], ["part", "sid"])


class Crowd:
    """Entries that are compared with each other. ``side``: entries of one side are not, unless it is negative."""

    def __init__(self, sid: np.ndarray, side: np.ndarray, rows: np.ndarray, sets: list[np.ndarray], miss: float):
        self.sid, self.side, self.rows, self.sets, self.miss = sid, side, rows, sets, miss
        self.size = np.array([len(s) for s in sets])
        self.root = np.arange(len(sid))
        self.postings = None

    def links(self) -> list[tuple[int, int]]:
        out = []
        for i in range(len(self.sid) - 1):
            rest = slice(i + 1, None)
            apart = (self.root[rest] != self.root[i]) & ((self.side[rest] != self.side[i]) | (self.side[i] < 0))
            small, large = np.minimum(self.size[rest], self.size[i]), np.maximum(self.size[rest], self.size[i])
            other = i + 1 + np.flatnonzero(apart & (DENOMINATOR * small >= NUMERATOR * large))
            if not len(other):
                continue
            found = agreements(self.rows[i], self.rows, other, self.miss)
            other = other[found >= 0][np.argsort(-found[found >= 0], kind="stable")]
            for j, common in zip(other.tolist(), self._common(i, other), strict=False):
                if self.root[i] == self.root[j]:
                    continue
                common = common()
                if DENOMINATOR * common >= NUMERATOR * (self.size[i] + self.size[j] - common):
                    out.append((int(self.sid[i]), int(self.sid[j])))
                    self.root[self.root == self.root[j]] = self.root[i]
        return out

    def _common(self, i: int, other: np.ndarray):
        """Sizes of the intersections with entry i: one by one if they are few, else all at once over the postings."""
        if len(other) <= FEW:
            return [functools.partial(self._intersection, i, j) for j in other.tolist()]
        if self.postings is None:
            _, of = np.unique(np.concatenate(self.sets), return_inverse=True)
            owner = np.repeat(np.arange(len(self.sets)), self.size)[np.argsort(of, kind="stable")]
            ends = np.cumsum(np.bincount(of))
            self.postings = np.split(of, np.cumsum(self.size)[:-1]), owner, ends - np.bincount(of), ends
        own, owner, starts, ends = self.postings
        starts, n = starts[own[i]], (ends - starts)[own[i]]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        counts = np.bincount(owner[at], minlength=len(self.sets))
        return [functools.partial(int, counts[j]) for j in other.tolist()]

    def _intersection(self, i: int, j: int) -> int:
        return len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))


def _searcher(miss: float):
    """Streams (crowd, chunk, side, sid, signature, shingles) sorted by crowd and chunk: the links found in each."""

    def rows(batches):
        key, held, out = None, [], []
        for batch in batches:
            crowd, chunk = batch.column("crowd").to_numpy(), batch.column("chunk").to_numpy()
            if not len(crowd):
                continue
            cuts = np.flatnonzero((crowd[1:] != crowd[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(crowd)], strict=True):
                if (crowd[a], chunk[a]) != key:
                    out += _found(held, miss)
                    key, held = (crowd[a], chunk[a]), []
                held.append(batch.slice(a, b - a))
            yield _pairs(out)
            out = []
        yield _pairs(_found(held, miss))

    return rows


def _found(held: list[pa.RecordBatch], miss: float) -> list[tuple[int, int]]:
    if not held:
        return []
    table = pa.Table.from_batches(held)
    sid, at = np.unique(table.column("sid").to_numpy(), return_index=True)  # a row that repeats may come twice
    if len(sid) < 2:
        return []
    table = table.take(at)
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    return Crowd(sid, table.column("side").to_numpy(), _signatures(table.column("signature")), sets, miss).links()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _sets(batches):
    """Full sets of the wanted entries, from texts; rows may repeat."""
    seen = set()
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            keep, lists = [], []
            named = zip(batch.column("sid").to_pylist(), batch.column("digest").to_pylist(), strict=True)
            for k, ((sid, wants), shingles) in enumerate(zip(named, shingle_sets(batch.column("text")), strict=True)):
                if sid not in seen and digest(shingles) == wants:
                    seen.add(sid)
                    keep.append(k)
                    lists.append(shingles.tobytes())
            kept = batch.select(["sid", "signature", "places"]).take(pa.array(keep, pa.int64()))
            yield kept.append_column("shingles", pa.array(lists, pa.binary()))


def entries_of(rows: DataFrame) -> DataFrame:
    """One entry for each set: sid, digest, least (id), doc_id and body of one text, n, signature."""
    at = F.min(F.struct("doc_id", "body")).alias("at")
    grouped = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("least"), at, F.max("n").alias("n"), F.max("signature").alias("signature")
    )
    flat = grouped.select("digest", "least", "at.doc_id", "at.body", "n", "signature")
    return stage(flat.withColumn("sid", F.monotonically_increasing_id()), "minhash-entries")


def _placed(groups: DataFrame, crowd: str) -> DataFrame:
    """sid, place: where an entry of a group is compared. groups: the group's name, sid, n.

    A group of several chunks is compared two chunks at a time; an entry goes to each pair that its own
    chunk is in, with its chunk as its side.
    """
    sizes = groups.groupBy(crowd).agg(F.count("*").alias("m"), F.sum("n").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("bytes") * 8 / CHUNK_BYTES)).alias("chunks")
    sized = groups.join(sizes.filter("m > 1").select(crowd, chunks), crowd)
    own = F.pmod(F.xxhash64("sid"), F.col("chunks"))
    place = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1),
        lambda k: F.struct(
            F.col(crowd).alias("crowd"),
            (F.least(own, k) * F.col("chunks") + F.greatest(own, k)).alias("chunk"),
            F.when(own == k, F.lit(-1).cast("bigint")).otherwise(own).alias("side"),
        ),
    )
    return sized.select("sid", F.explode(place).alias("place"))


def places(entries: DataFrame) -> DataFrame:
    """sid, places: the chunks of crowds, or of buckets of very large crowds, in which entries are compared."""
    index = entries.select("sid", "signature").mapInArrow(_bands, "part bigint, sid bigint")
    buckets = index.groupBy("part").agg(F.min("sid").alias("hub"), F.max("sid").alias("last"))
    shared = stage(index.join(buckets.filter("hub < last"), "part").select("part", "hub", "sid"), "minhash-shared")
    stars = shared.filter("sid > hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    linked = components(stars)
    roots = linked.select(F.col("root").alias("sid"), "root").distinct()
    members = linked.select(F.col("node").alias("sid"), "root").unionByName(roots)
    sized = members.join(entries.select("sid", "n"), "sid")
    large = members.groupBy("root").count().filter(F.col("count") > CROWD).select("root")
    crowds = sized.join(large, "root", "left_anti")
    scattered = shared.join(sized.join(large, "root", "left_semi"), "sid").select("part", "sid", "n")
    dealt = _placed(crowds, "root").unionByName(_placed(scattered, "part"))
    return dealt.groupBy("sid").agg(F.collect_list("place").alias("places"))


def links(df: DataFrame, entries: DataFrame, key: str, text: str, miss: float) -> DataFrame:
    """(a, b) over entries: the links that join all linked entries, directly or over others."""
    wanted = stage(
        entries.join(places(entries), "sid").select("sid", "digest", "doc_id", "body", "signature", "places"),
        "minhash-wanted",
    )
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), _body(text).alias("body"), F.col(text).alias("text"))
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["body"] == wanted["body"])
    texts = docs.join(wanted, same).select("sid", "digest", "signature", "places", "text")
    place = "struct<crowd:bigint,chunk:bigint,side:bigint>"
    sets = texts.mapInArrow(_sets, f"sid bigint, signature binary, places array<{place}>, shingles binary")
    dealt = sets.select("sid", "signature", "shingles", F.explode("places").alias("place"))
    rows = dealt.select("place.*", "sid", "signature", "shingles").repartition("crowd", "chunk")
    found = rows.sortWithinPartitions("crowd", "chunk").mapInArrow(_searcher(miss), "a bigint, b bigint")
    return stage(found, "minhash-links")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the row has the smallest id of its class) for each row."""
    rows = stage(document_sets(df, key, text), "minhash-rows")
    entries = entries_of(rows)
    roots = components(links(df, entries, key, text, miss))
    rooted = entries.join(roots, F.col("sid") == F.col("node"), "left").select(
        "digest", "least", F.coalesce("root", "sid").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "component_id")
    joined = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )
