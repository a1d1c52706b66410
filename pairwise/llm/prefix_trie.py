"""Prefix trie of conversations by union-find over sorted neighbours.

Each conversation is the sequence of 16-byte digests of its turns, its path. Paths are range-partitioned
and sorted, so conversations that share a prefix are neighbours; the depth to which two neighbours agree
is an edge between them. A task unites the neighbours of its partition in descending depth of their edges:
every merge makes or joins a branching node, and the nodes between two merges are a chain. When a component
rises past a depth, the node at that depth has all its members and is told.

A node on the path of a partition's first or last conversation may have members in other partitions. Such
nodes are left open: the partition is contracted to these two paths, each with what the partition adds to
its nodes (members, complete children, leaves and tokens of complete subtrees). The contracted paths of all
partitions are sorted and united by the same routine, in rounds, until one partition holds them; the
nodes then closed give their names to children closed before. Only paths, counts and ids are moved; nothing
passes through the driver.

``members`` (ids of conversations that end at a node) are hashed as a stream: partitions send text chunks of
some KB, which are put in order and fed to one SHA-256, so the list of a node is never held as a whole.

Rows are ordered by turn (null first), then role, then text; null roles and texts are empty; rows that
repeat are repeated turns. A row without a conversation id belongs to no conversation and is left out. An
empty table gives no node. Other columns are not read. One conversation is a path that one task holds, at
24 bytes a turn; its texts are never held together.
"""

import hashlib
import zlib
from itertools import pairwise as neighbours

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairwise.session import stage

WIDTH = 16  # bytes of a turn's digest
GROUP = 5  # conversations that share the turns of the first of them
MOST_SHARED = 8
PARTITION_BYTES = 8 << 20  # of paths that one task unites, counted with ROW_BYTES for each
ROW_BYTES = 160
CHUNK = 1000  # ids of a list that are sent at a time
BATCH = 4096
NO_ID = np.iinfo(np.int64).max
EMPTY = hashlib.sha256().hexdigest()

_PATHS = "conv_id bigint, path binary, lengths binary"
_TOLD = (
    "kind string, conv_id bigint, depth bigint, key binary, parent_conv_id bigint, parent_key binary, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, path binary, lengths binary, "
    "added binary, ids string"
)


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


def turns_of(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of each group of conversations together and in order: family, conv_id, digest and length of each turn."""
    conv = F.col(key).cast("bigint")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text")
    )
    family = F.col("conv_id") - F.col("conv_id") % GROUP
    dealt = rows.withColumn("family", family).repartition("family")
    ordered = dealt.sortWithinPartitions("family", "conv_id", F.asc_nulls_first("turn"), "role", "text")
    length = F.octet_length("text").cast("bigint")
    body = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return ordered.select("family", "conv_id", F.unhex(F.md5(body.cast("binary"))).alias("digest"), length.alias("length"))


def rebuild(batches):
    """One row for each conversation: the first turns of its family's first conversation, then its own later ones."""
    rebuilt = Rebuilder()
    for batch in batches:
        family, conv = batch.column("family").to_numpy(), batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        digests = b"".join(batch.column("digest").to_pylist())
        lengths = batch.column("length").to_numpy()
        cuts = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)], strict=True):
            rebuilt.add(int(family[a]), int(conv[a]), digests[WIDTH * a : WIDTH * b], lengths[a:b].tobytes())
            if len(rebuilt.done) >= BATCH:
                yield rebuilt.take()
    rebuilt.end()
    yield rebuilt.take()


class Rebuilder:
    """Takes runs of turns in the order of (family, conversation)."""

    def __init__(self):
        self.done, self.conv, self.family, self.first = [], None, None, (b"", b"")
        self.held: list[tuple[bytes, bytes]] = []

    def add(self, family: int, conv: int, digests: bytes, lengths: bytes):
        if conv != self.conv:
            self.end()
            if family != self.family:
                self.family, self.first = family, (b"", b"")
            self.conv = conv
        self.held.append((digests, lengths))

    def end(self):
        if self.conv is None:
            return
        path, lengths = (b"".join(x) for x in zip(*self.held, strict=True))
        self.held = []
        if self.conv == self.family:
            self.first = path[: WIDTH * MOST_SHARED], lengths[: 8 * MOST_SHARED]
        h = shared_turns(self.conv)
        self.done.append((
            self.conv,
            self.first[0][: WIDTH * h] + path[WIDTH * h :],
            self.first[1][: 8 * h] + lengths[8 * h :],
        ))
        self.conv = None

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [(), (), ()]
        self.done = []
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "path", "lengths"]
        )


def common_depth(one: bytes, other: bytes) -> int:
    """Turns to which two paths agree."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return n // WIDTH
    a, b = np.frombuffer(one, np.uint8, n), np.frombuffer(other, np.uint8, n)
    return int(np.argmax(a != b)) // WIDTH


def node_key(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: WIDTH * depth], digest_size=16).digest()


class Forest:
    """Unites sorted paths. ``added[i]`` maps depths to what path i adds to the nodes there (see ``_nothing``).

    Nodes on the first or last path stay open unless ``whole``: what is known of them goes to ``spines``, by
    path and depth. ``nodes`` holds the closed ones: a path and depth, members, least id, children, leaves,
    saved tokens, and the node above, which is a place in ``nodes``, or the path and depth of an open node.
    """

    def __init__(self, paths: list[bytes], lengths: list[bytes], added: list[dict], whole: bool):
        n = len(paths)
        self.whole, self.end = whole, n - 1
        self.lengths, self.added = lengths, added
        self.depth = [len(p) // WIDTH for p in paths]  # of the node in which a component ends at present
        self.parent = list(range(n))  # a component is named by its first path
        self.last = list(range(n))
        self.sums = [_nothing() for _ in range(n)]
        self.below: list[list[int]] = [[] for _ in range(n)]  # closed children of the present node
        self.nodes: list[list] = []
        self.spines: dict[int, dict] = {} if whole else {0: {}, self.end: {}}
        for i in range(n):
            self._enter(i)
        edges = sorted((-common_depth(a, b), i) for i, (a, b) in enumerate(neighbours(paths)))
        for depth, i in edges:
            self._unite(self._find(i), i + 1, -depth)
        if n:
            self._rise(0, -1)

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _enter(self, c: int):
        """A component has come to a node: take up what its paths add there."""
        more = self.added[c].pop(self.depth[c], None)
        if more:
            self.sums[c] = _plus(self.sums[c], more)

    def _rise(self, c: int, to: int):
        """Close the nodes of a component that are deeper than ``to``."""
        while self.depth[c] > to:
            self._close(c, self.depth[c])
            self.depth[c] -= 1
            self._enter(c)

    def _close(self, c: int, d: int):
        n, least, children, leaves, saved = self.sums[c]
        children += len(self.below[c])
        if not self.whole and (c == 0 or self.last[c] == self.end):
            at = 0 if c == 0 else self.end
            self.spines[at][d] = [n, least, children, leaves, saved]
            for k in self.below[c]:
                self.nodes[k][-1] = (at, d)
            self.below[c], self.sums[c] = [], _nothing()
            return
        leaves = leaves or int(children == 0)
        if d:
            saved += (n - 1) * int.from_bytes(self.lengths[c][8 * d - 8 : 8 * d], "little")
        for k in self.below[c]:
            self.nodes[k][-1] = len(self.nodes)
        self.below[c], self.sums[c] = [len(self.nodes)], [n, least, 0, leaves, saved]
        self.nodes.append([c, d, n, least, children, leaves, saved, None])

    def _unite(self, a: int, b: int, depth: int):
        self._rise(a, depth)
        self._rise(b, depth)
        small, large = sorted((self.below[a], self.below[b]), key=len)
        large += small
        self.below[a], self.below[b] = large, []
        self.sums[a] = _plus(self.sums[a], self.sums[b])
        for d, more in self.added[b].items():
            self.added[a][d] = _plus(self.added[a].get(d, _nothing()), more)
        self.parent[b], self.last[a] = a, self.last[b]


def _nothing() -> list[int]:
    """Members and their least id, closed children, leaves and saved tokens of closed subtrees."""
    return [0, NO_ID, 0, 0, 0]


def _plus(a: list[int], b: list[int]) -> list[int]:
    return [a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4]]


def _id_lists(paths: list[bytes], ids: list[int]):
    """First place and ids of each run of equal paths."""
    start = 0
    for i in range(1, len(paths) + 1):
        if i == len(paths) or paths[i] != paths[start]:
            yield start, ids[start:i]
            start = i


_NAMES = [x.split()[0] for x in _TOLD.split(", ")]
_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_TYPES = [_KINDS[x.split()[1]] for x in _TOLD.split(", ")]


def _told(rows: list[dict]):
    for k in range(0, len(rows), BATCH):
        part = rows[k : k + BATCH]
        columns = [pa.array([r.get(c) for r in part], t) for c, t in zip(_NAMES, _TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


def _closed(forest: Forest, paths: list[bytes], ends: dict[int, str] | None):
    """Rows of the closed nodes. ``ends``: by path the hash of the ids that end there; without, nodes get keys."""
    for c, d, n, least, children, leaves, saved, above in forest.nodes:
        row = {
            "kind": "node", "conv_id": least, "depth": d, "n_convs": n, "n_children": children,
            "n_leaves": leaves, "saved_tokens": saved,
        }
        if isinstance(above, int):
            row["parent_conv_id"] = forest.nodes[above][3]
        elif above:
            row["parent_key"] = node_key(paths[above[0]], above[1])
        if ends is None:
            row["key"] = node_key(paths[c], d)
        else:
            row["ends_sha256"] = ends[c] if d * WIDTH == len(paths[c]) else EMPTY
        yield row


def _contracted(forest: Forest, paths: list[bytes], lengths: list[bytes]):
    for at, adds in forest.spines.items():
        table = np.array([adds.get(d, _nothing()) for d in range(len(paths[at]) // WIDTH + 1)], "<i8")
        yield {"kind": "spine", "path": paths[at], "lengths": lengths[at], "added": table.tobytes()}


def unite_conversations(batches):
    """One partition of sorted conversations: closed nodes, id lists of open nodes in chunks, two contracted paths."""
    ids, paths, lengths = _gathered(batches, ("conv_id", "path", "lengths"))
    if not paths:
        return
    forest = Forest(paths, lengths, [{len(p) // WIDTH: [1, c, 0, 0, 0]} for p, c in zip(paths, ids, strict=True)], False)
    ends, rows = {}, []
    for start, own in _id_lists(paths, ids):
        if paths[0].startswith(paths[start]) or paths[-1].startswith(paths[start]):
            key = node_key(paths[start], len(paths[start]) // WIDTH)
            for k in range(0, len(own), CHUNK):
                part = own[k : k + CHUNK]
                rows.append({"kind": "ends", "key": key, "conv_id": part[0], "ids": ",".join(map(str, part))})
        else:
            ends[start] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
    yield from _told(rows)
    yield from _told(list(_closed(forest, paths, ends)))
    yield from _told(list(_contracted(forest, paths, lengths)))


def _uniter(whole: bool):
    """One partition of sorted contracted paths: the nodes that can be closed now, and its two contracted paths."""

    def unite(batches):
        paths, lengths, tables = _gathered(batches, ("path", "lengths", "added"))
        if not paths:
            return
        added = []
        for table in tables:
            rows = np.frombuffer(table, "<i8").reshape(-1, 5)
            filled = np.flatnonzero((rows[:, 0] > 0) | (rows[:, 2] > 0))
            added.append({int(d): rows[d].tolist() for d in filled})
        forest = Forest(paths, lengths, added, whole)
        yield from _told(list(_closed(forest, paths, None)))
        yield from _told(list(_contracted(forest, paths, lengths)))

    return unite


def _gathered(batches, names: tuple[str, ...]) -> list[list]:
    columns: list[list] = [[] for _ in names]
    for batch in batches:
        for column, name in zip(columns, names, strict=True):
            column += batch.column(name).to_pylist()
    return columns


def _hash_ids(batches):
    """Streams (key, conv_id, ids) in order: one hash for each key."""
    key, hashed = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if hashed:
                    done.append((key, hashed.hexdigest()))
                key, hashed = k, hashlib.sha256(ids.encode())
            else:
                hashed.update(f",{ids}".encode())
        yield _hashed(done)
    yield _hashed([(key, hashed.hexdigest())] if hashed else [])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), ()]
    kinds = (pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["of", "hashed"])


def _partitions(paths: DataFrame, partition_bytes: int) -> tuple[int, int]:
    """Partitions of about the wanted size, and rows."""
    size = F.sum(F.octet_length("path") + F.octet_length("lengths") + ROW_BYTES)
    found = paths.agg(size.alias("bytes"), F.count("*").alias("rows")).first()
    return -(-(found["bytes"] or 0) // partition_bytes), found["rows"]


def trie(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = df.sparkSession
    paths = stage(turns_of(df, key, turn, role, text).mapInArrow(rebuild, _PATHS), "trie-paths")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _partitions(paths, partition_bytes)[0])
    dealt = paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    told = [stage(dealt.mapInArrow(unite_conversations, _TOLD), "trie-forests")]
    whole = False
    while not whole:
        spines = told[-1].filter("kind = 'spine'").select("path", "lengths", "added")
        parts, rows = _partitions(spines, partition_bytes)
        whole = parts < 2 or 2 * parts >= rows  # each partition leaves two paths
        dealt = spines.repartition(1) if whole else spines.repartitionByRange(parts, "path")
        told.append(stage(dealt.sortWithinPartitions("path").mapInArrow(_uniter(whole), _TOLD), "trie-forests"))
    return _named(told)


def _named(told: list[DataFrame]) -> DataFrame:
    """Nodes of all rounds with the names of their parents and the hashes of their ids."""
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    chunks = told[0].filter("kind = 'ends'").select("key", "conv_id", "ids")
    ordered = chunks.repartition("key").sortWithinPartitions("key", "conv_id")
    hashed = ordered.mapInArrow(_hash_ids, "of binary, hashed string")
    first = told[0].filter("kind = 'node'")
    later = told[1].filter("kind = 'node'")
    for more in told[2:]:
        later = later.unionByName(more.filter("kind = 'node'"))
    ended = later.join(hashed, later["key"] == hashed["of"], "left").withColumn(
        "ends_sha256", F.coalesce("hashed", F.lit(EMPTY))
    )
    names = later.select(F.col("key").alias("of"), F.col("conv_id").alias("named"))
    nodes = first.select(*out, "parent_key").unionByName(ended.select(*out, "parent_key"))
    open_ = nodes.filter("parent_key is not null")
    joined = open_.join(names, open_["parent_key"] == names["of"]).withColumn("parent_conv_id", F.col("named"))
    return nodes.filter("parent_key is null").select(out).unionByName(joined.select(out))
