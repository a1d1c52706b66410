"""Session settings and the shared folder for staged tables."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Sized in bytes rather than in a number of cores, so AQE picks the partition counts.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Sequences can be 100 KB each: keep Arrow batches at tens of MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="pairwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/pairwise-{name}-{uuid.uuid4().hex}"


_owners: list[list[str]] = []


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


@contextmanager
def owned_staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end, so their frames must not leave it."""
    _owners.append([])
    try:
        yield
    finally:
        for path in _owners.pop():
            files, at = hadoop_path(spark, path)
            files.delete(at, True)


@contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Inside the block, column names that differ in case only are different names."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


OPEN_FILES = 100


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Inside the block a task of a partitioned write keeps up to ``OPEN_FILES`` files open and streams its rows.

    Otherwise it sorts them by their folder first, and holds as many as it can. Rows of further folders are still sorted.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one read, and gives the optimizer the true size,
    which decides whether later joins may broadcast it. The innermost ``owned_staging`` deletes it.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
