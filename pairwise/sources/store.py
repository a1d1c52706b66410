"""Feature store: bucketed Parquet in batches, a manifest, and a Bloom filter for each batch.

``data`` is one table, partitioned by batch and bucketed by the entity id, so a join or aggregate on the id
needs no shuffle on its side. ``manifest`` has a row for each batch and bucket with the number of keys and a
Bloom filter of them. A batch counts once all of its manifest rows are there: data that a dying run
has written without them is never read. To see which of the wanted entities are stored, the ids (nothing
else) meet the filters of their bucket; the ids that no batch may hold are new, and of the store only
the id column of the batches that may hold one of the others is read.

The number of buckets is fixed when the store is made: ``spark.sql.shuffle.partitions`` at that time. Two
runs that extend a store at the same time may store an entity twice. A batch lists the batches that its run
saw, so readers know whether that is possible, and only then drop repeated ids, within their buckets.
Buckets are known to Spark through a table, so the session gets an external table ``pairwise_store_…``.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairwise.session import hadoop_path, stage

COMMIT = 1_000_000  # entities of one batch
BITS = 12  # of the filter for each key, and the probes of it: about 1 in 300 strange keys passes
PROBES = 8

_MANIFEST = "batch string, bucket int, keys bigint, filter binary, parts int, buckets int, seen array<string>"


def _probes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Bit places of each 64-bit hash: double hashing with its two halves."""
    low, high = hashed & np.uint64(0xFFFFFFFF), (hashed >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(size)


def bloom_filter(hashed: np.ndarray) -> bytes:
    size = max(64, -(-len(hashed) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    bits[_probes(hashed, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(data: bytes, hashed: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(data, np.uint8)
    at = _probes(hashed, 8 * len(bits))
    return ((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def _bucket(key: str, buckets: int):
    """The bucket that Spark's writer puts a key into."""
    return F.pmod(F.hash(key), F.lit(buckets))


class Store:
    """A store in a folder; ``schema`` is that of its rows, ``key`` the entity id."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        committed = self.manifest()
        # a row for each batch
        self.batches = {r["batch"]: set(r["seen"]) for r in committed.select("batch", "seen").distinct().collect()}
        sizes = committed.agg(F.max("buckets")).first()[0]
        self.buckets = sizes or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def manifest(self) -> DataFrame:
        """Rows of the batches whose rows are all there."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], _MANIFEST)
        whole = rows.groupBy("batch").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).filter("n = parts")
        return rows.join(whole.select("batch"), "batch")

    def _table(self) -> str:
        """Name of the bucketed table over ``data``, made known to the session with the batches that are there."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        of = f"{self.path} {self.buckets} {columns}"
        name = f"pairwise_store_{hashlib.md5(of.encode()).hexdigest()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )
        disk, at = hadoop_path(self.spark, f"{self.path}/data")
        disk.mkdirs(at)
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def rows(self, batches=None) -> DataFrame:
        """Stored rows of all committed batches, or of those named."""
        names = sorted(self.batches if batches is None else batches)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        table = self.spark.table(self._table())
        return table.filter(F.col("batch").isin(names)).drop("batch")

    def features(self) -> DataFrame:
        """Stored rows, one for each key."""
        rows = self.rows()
        return rows if self.is_serial() else rows.dropDuplicates([self.key])

    def is_serial(self) -> bool:
        """Has of each two batches one been written in sight of the other? Then no key is stored twice."""
        order = sorted(self.batches, key=lambda b: len(self.batches[b]))
        return all(set(order[:k]) <= self.batches[batch] for k, batch in enumerate(order))

    def known(self, wanted: DataFrame) -> DataFrame:
        """Those of the wanted keys that are stored."""
        keys = wanted.select(self.key)
        if not self.batches:
            return keys.limit(0)
        hashed = keys.withColumns({"_bucket": _bucket(self.key, self.buckets), "_hash": F.xxhash64(self.key)})
        filters = self.manifest().select(F.col("bucket").alias("_bucket"), "batch", "filter")
        kind = keys.schema[self.key].dataType
        schema = T.StructType([T.StructField(self.key, kind), T.StructField("batches", T.ArrayType(T.StringType()))])
        found = hashed.groupBy("_bucket").cogroup(filters.groupBy("_bucket")).applyInArrow(_prober(self.key), schema)
        probed = stage(found, "store-probe")
        # a row for each batch that may hold a key
        needed = [r[0] for r in probed.select(F.explode("batches")).distinct().collect()]
        if not needed:
            return keys.limit(0)
        return self.rows(needed).select(self.key).join(probed.select(self.key), self.key, "left_semi")

    def append(self, frame: DataFrame) -> None:
        """Write a batch: first the rows, then, to make them count, its manifest."""
        batch = f"{len(self.batches):06d}-{uuid.uuid4().hex}"
        columns = [f"`{f.name}`" for f in self.schema.fields]
        dealt = frame.select(*columns).repartition(self.buckets, self.key).withColumn("batch", F.lit(batch))
        dealt.write.insertInto(self._table())
        self.commit(batch)

    def commit(self, batch: str) -> None:
        seen = sorted(self.batches)
        keys = self.rows([batch]).select(_bucket(self.key, self.buckets).alias("bucket"), F.xxhash64(self.key).alias("hash"))
        filters = keys.groupBy("bucket").applyInArrow(_build, "bucket int, keys bigint, filter binary")
        filters = stage(filters, "store-filters")
        parts = filters.count()
        if not parts:
            return
        rows = filters.select(
            F.lit(batch).alias("batch"), "bucket", "keys", "filter", F.lit(parts).alias("parts"),
            F.lit(self.buckets).alias("buckets"), F.array(*map(F.lit, seen)).cast("array<string>").alias("seen"),
        )
        rows.write.mode("append").parquet(f"{self.path}/manifest")
        self.batches[batch] = set(seen)


def _build(table: pa.Table) -> pa.Table:
    hashed = table.column("hash").to_numpy().view(np.uint64)
    columns = [pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([len(hashed)], pa.int64())]
    return pa.table([*columns, pa.array([bloom_filter(hashed)], pa.binary())], ["bucket", "keys", "filter"])


def _prober(key: str):
    """Keys of a bucket that some batch may hold, with these batches."""

    def probe(wanted: pa.Table, filters: pa.Table) -> pa.Table:
        hashed = wanted.column("_hash").to_numpy().view(np.uint64)
        held: list[list[str]] = [[] for _ in range(len(hashed))]
        for batch, data in zip(filters.column("batch").to_pylist(), filters.column("filter").to_pylist(), strict=True):
            for k in np.flatnonzero(may_hold(data, hashed)).tolist():
                held[k].append(batch)
        found = wanted.select([key]).append_column("batches", pa.array(held, pa.list_(pa.string())))
        return found.filter(pa.array([bool(x) for x in held], pa.bool_()))

    return probe


def extend_store(
    unique: DataFrame, path: str, key: str, compute, commit: int = COMMIT
) -> DataFrame:
    """Compute the entities that the store lacks, append them, return the whole store.

    They are computed and appended in batches of about ``commit`` entities, by a hash of the key. Each
    batch commits as a whole, so a run that dies goes on after its last finished batch.
    """
    store = Store(unique.sparkSession, path, compute(unique.limit(0)).schema, key)
    todo = unique.join(store.known(unique), key, "left_anti") if store.batches else unique
    # the pending entities are fixed now: a batch must not change what a later one takes
    todo = stage(todo, "pending")
    batches = -(-todo.count() // commit)
    for k in range(batches):
        part = todo.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k) if batches > 1 else todo
        store.append(compute(part))
    return store.features()
