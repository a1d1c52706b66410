"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves only. If two fingerprints differ in at most three bits, one of
the halves differs in at most one, so they agree on a half with one bit wildcarded. Each distinct
fingerprint is indexed under all 64 variants (half, wildcard), equal variants meet by an equality shuffle,
and pairs that meet are verified by the number of bits in which they differ.

A bucket of m fingerprints is verified in place, block by block, and returns a spanning forest of its
links, at most m - 1 rows, never its pairs. A bucket of more than ``BUCKET`` members is not gathered: its
members are indexed anew. The bits that its signature leaves open are cut into four parts, one of which
must be equal for a link, and so on until the buckets are small; with few bits left, they must be. Copies
never meet: the index holds each fingerprint once.

Fingerprint: bit b is set if more than half of the document's 3-word shingles (repeats included) have it
in their XXH64. Words are split at ASCII white space, A-Z lower-cased; a text of fewer words is one
shingle. Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat belong
to one class; a class whose ids are all null has a null component. Only id and text are read.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pairwise.llm.arrow_text import LOWERED, SLICE, short_batches, slices
from pairwise.llm.components import components
from pairwise.session import stage

SHINGLE = 3
SEED = 42
DISTANCE = 3
BUCKET = 2048  # fingerprints that are compared with each other in one place (8 or more)
_FOLD = LOWERED.tobytes()
_ROWS = 1 << 15


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    hashed = np.array(found, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashed), _ROWS):
        bits = np.unpackbits(hashed[k : k + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body (a hash of the text) and fp (the fingerprint as a signed long) for each row."""

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                made = [_signed(fingerprint(x)) for x in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), batch.column("body"), pa.array(made, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "fp"])

    picked = short_batches(df).select(
        F.col(key).cast("bigint").alias("doc_id"), _body(text).alias("body"), F.col(text).alias("text")
    )
    return picked.mapInArrow(rows, "doc_id bigint, body bigint, fp bigint")


def _body(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def first_masks() -> list[int]:
    """The bits that each of the 64 variants keeps: a half without one of its bits."""
    half = (1 << 32) - 1
    return [(half << 32 * (b // 32)) & ~(1 << b) for b in range(64)]


def next_masks(mask: int) -> list[int]:
    """A mask widened by each of four parts of the bits that it leaves open."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in open_bits[k :: DISTANCE + 1]) for k in range(DISTANCE + 1)]


def _spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members at most DISTANCE bits apart, by search from node to node."""
    rest, links = members, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= DISTANCE
            if near.any():
                found = rest[near]
                links += [(int(node), int(x)) for x in found.view(np.int64)]
                queue += list(found)
                rest = rest[~near]
    return [(_signed(a), b) for a, b in links]


def _verifier(most: int):
    """Streams rows sorted by (mask, part, fp): links of small buckets, members of large ones (b is null)."""

    def rows(batches):
        key, held, large = None, [], False  # of the bucket that the last batch ended in

        def done():
            if large or not held:
                return []
            members = np.unique(np.concatenate(held))
            return [(None, *x) for x in _spanning(members)]

        for batch in batches:
            out: list[tuple] = []
            mask, part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(fp):
                continue
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = np.concatenate(([0], change, [len(fp)]))
            sizes = np.diff(bounds)
            edge = np.zeros(len(sizes), bool)
            edge[[0, -1]] = True
            pair = bounds[:-1][(sizes == 2) & ~edge]  # most buckets have one member, most others two
            near = pair[np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= DISTANCE]
            out += [(None, x, y) for x, y in zip(fp[near].tolist(), fp[near + 1].tolist(), strict=True) if x != y]
            for k in np.flatnonzero((sizes > 2) | edge).tolist():
                a, b = bounds[k], bounds[k + 1]
                if (mask[a], part[a]) != key:
                    out += done()
                    key, held, large = (mask[a], part[a]), [], False
                held.append(fp[a:b].view(np.uint64))
                large = large or sum(map(len, held)) > most
                if large:  # pass the members on
                    out += [(int(key[0]), int(x), None) for x in np.concatenate(held).view(np.int64)]
                    held = []
            yield _links(out)
        yield _links(done())

    return rows


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["mask", "a", "b"])


def _again(batches):
    """Members of large buckets under four wider masks each."""
    for batch in batches:
        mask, fp = batch.column("mask").to_numpy(), batch.column("a").to_numpy()
        for m in np.unique(mask):
            own = fp[mask == m]
            for wider in next_masks(int(m) & ((1 << 64) - 1)):
                kept = np.full(len(own), _signed(wider))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept), pa.array(own & kept), pa.array(own)], ["mask", "part", "fp"]
                )


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that join all fingerprints at most three bits apart, directly or over others."""
    masks = F.array(*[F.lit(_signed(m)) for m in first_masks()])
    index = distinct.select(F.explode(masks).alias("mask"), "fp").select(
        "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp"
    )
    found = None
    while True:
        dealt = index.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        seen = stage(dealt.mapInArrow(_verifier(BUCKET), "mask bigint, a bigint, b bigint"), "near")
        new = seen.filter("b is not null").select("a", "b")
        found = new if found is None else found.unionByName(new)
        large = seen.filter("b is null").select("mask", "a").distinct()
        if large.isEmpty():
            return found.distinct()
        index = large.mapInArrow(_again, "mask bigint, part bigint, fp bigint").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """fp, root (a fingerprint that names the class), component_id for each distinct fingerprint."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id of all rows reachable by links) for each row."""
    rows = stage(fingerprints(df, key, text), "fingerprints")
    return rows.join(classes(rows), "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns: that of the smallest id, null last; of equal ids, one of them."""
    names = df.columns
    rows = stage(fingerprints(df, key, text), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")
    best = rows.groupBy("fp").agg(F.min(rank).alias("rank"))  # before the join: copies meet here
    chosen = best.join(classes(rows), "fp").groupBy("root").agg(F.min("rank").alias("rank")).select("rank.*")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    whole = df.select(row.alias("row"), F.col(key).cast("bigint").alias("doc_id"), _body(text).alias("body"))
    same = whole["doc_id"].eqNullSafe(chosen["doc_id"]) & (whole["body"] == chosen["body"])
    kept = whole.join(chosen, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "body"]).select("row.*")
