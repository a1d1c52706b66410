"""Catalogue of prediction files: which there are and what their headers say, read on the executors.

``pairwise_files`` is a data source whose partitions are files. The driver asks the file system for the names
once (as any file scan does) and opens no file; the executors open them, some hundred to a task, and return
path, size and header cells, or the error. Names that Spark's own readers hide, since they begin with an
underscore or a dot, are files like any other, and their contents are read on the executors too.

Paths are opened by ``pyarrow.fs``: local and mounted folders, HDFS, S3, GCS, Azure. For a file system that
only Hadoop knows, the catalogue falls back on the file system client of the driver.
"""

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairwise.sources.listing import find_files, header_cells

FILES_PER_TASK = 200
RANGE = 64 << 20  # bytes of a hidden file that one task reads
READ = 1 << 20
HEAD = 64 << 10  # bytes that are read at first to find a header

_SCHEMA = "path string, folder string, name string, bytes bigint, header array<string>, error string"
_ARROW = pa.schema([
    ("path", pa.string()), ("folder", pa.string()), ("name", pa.string()), ("bytes", pa.int64()),
    ("header", pa.list_(pa.string())), ("error", pa.string()),
])


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, the path in its terms, and what stands before that in the whole path."""
    bare = re.sub("^file:/+", "/", path)
    if "://" not in bare:
        return pafs.LocalFileSystem(), bare, "file:"
    system, inner = pafs.FileSystem.from_uri(bare)
    return system, inner, bare.removesuffix(inner)


def first_line(stream) -> bytes | None:
    """The first line of a binary stream that is not blank, without its end; None if there is none."""
    held = b""
    while True:
        more = stream.read(HEAD)
        held += more
        while b"\n" in held or (held and not more):
            line, _, held = held.partition(b"\n")
            if line.removeprefix(b"\xef\xbb\xbf").strip():
                return line.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r")
        if not more:
            return None


def cells_of(line: bytes | None) -> list[str]:
    return next(csv.reader(io.StringIO(line.decode()))) if line else []


@dataclass
class Files(InputPartition):
    """Files of one task: path and size."""

    files: list[tuple[str, int]]


class FileCatalogue(DataSource):
    """Options: ``path`` (a run), ``suffix`` (of file names). Files one level below the run, hidden or not."""

    @classmethod
    def name(cls) -> str:
        return "pairwise_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> "CatalogueReader":
        return CatalogueReader(self.options["path"], self.options.get("suffix", ""))


class CatalogueReader(DataSourceReader):
    def __init__(self, run: str, suffix: str):
        self.run, self.suffix = run, suffix

    def partitions(self) -> list[Files]:
        system, inner, before = opened(self.run.rstrip("/"))
        depth = inner.rstrip("/").count("/") + 2
        listed = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=True))
        found = sorted(
            (before + x.path, x.size)
            for x in listed
            if x.type == pafs.FileType.File and x.path.endswith(self.suffix) and x.path.count("/") == depth
        )
        return [Files(found[k : k + FILES_PER_TASK]) for k in range(0, len(found), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, size in partition.files:
            header, error = None, None
            try:
                system, inner, _ = opened(path)
                with system.open_input_stream(inner) as stream:
                    header = cells_of(first_line(stream))
            except Exception as failure:  # a file that cannot be read is reported, not fatal
                error = f"{type(failure).__name__}: {failure}"
            *_, folder, name = path.split("/")
            rows.append({"path": path, "folder": folder, "name": name, "bytes": size, "header": header, "error": error})
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def discovered_files(spark: SparkSession, run: str, suffix: str) -> DataFrame:
    """path, folder, name, bytes, header (null if it cannot be read), error: files one level below the run.

    Files of folders whose names begin with a dot are left out.
    """
    try:
        opened(run)
    except (pa.ArrowException, OSError, ValueError):
        return _by_client(spark, run, suffix)
    spark.dataSource.register(FileCatalogue)
    found = spark.read.format("pairwise_files").option("path", run).option("suffix", suffix).load()
    return found.filter(~F.col("folder").startswith("."))


def _by_client(spark: SparkSession, run: str, suffix: str) -> DataFrame:
    rows = []
    for path in find_files(spark, f"{run.rstrip('/')}/*/*{suffix}"):
        *_, folder, name = path.split("/")
        if folder.startswith("."):
            continue
        try:
            rows.append((path, folder, name, None, header_cells(spark, path), None))
        except Exception as failure:
            rows.append((path, folder, name, None, None, str(failure)))
    return spark.createDataFrame(rows, _SCHEMA)


def is_hidden(path: str) -> bool:
    """Would Spark's readers pass this file over?"""
    return path.rsplit("/", 1)[-1][0] in "._"


def hidden_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line: the lines below the header of files of hidden names, cut into ranges that tasks share."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    ranges = files.mapInArrow(_ranges, "path string, start bigint, stop bigint")
    dealt = ranges.repartition("path", "start")
    return dealt.mapInArrow(_range_lines, "path string, line string")


def _ranges(batches):
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            system, inner, _ = opened(path)
            size = system.get_file_info(inner).size
            rows += [{"path": path, "start": a, "stop": min(a + RANGE, size)} for a in range(0, size, RANGE)]
        kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, kinds)


def lines_of_range(path: str, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin in the range; the header and blank lines are left out."""
    system, inner, _ = opened(path)
    header = start == 0
    with system.open_input_file(inner) as file:
        file.seek(max(0, start - 1))
        stream = io.BufferedReader(file, READ)
        at = max(0, start - 1)
        if start:  # the line that holds the byte before the range belongs to the range before
            at += len(stream.readline())
        while at < stop:
            line = stream.readline()
            if not line:
                return
            at += len(line)
            text = line.removeprefix(b"\xef\xbb\xbf").rstrip(b"\n").removesuffix(b"\r")
            if text.strip():
                if not header:
                    yield text
                header = False


def _range_lines(batches):
    for batch in batches:
        for path, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            held = []
            for line in lines_of_range(path, start, stop):
                held.append(line)
                if len(held) == 4096:
                    yield _lines(path, held)
                    held = []
            yield _lines(path, held)


def _lines(path: str, lines: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(lines), pa.string()), pa.array([x.decode(errors="replace") for x in lines], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "line"])


def hidden_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, value: whole files of hidden names."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    return files.mapInArrow(_whole_texts, "path string, value string")


def _whole_texts(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner, _ = opened(path)
            with system.open_input_stream(inner) as stream:
                text = stream.read().decode(errors="replace")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], ["path", "value"])
