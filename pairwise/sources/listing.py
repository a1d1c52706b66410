"""Input files by the Hadoop file system, and header lines."""

import csv
import io
from collections import Counter

from pyspark.sql import SparkSession

from pairwise.session import hadoop_path


def find_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that a glob matches, in order, whatever their names begin with."""
    files, at = hadoop_path(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(at) or [] if s.isFile())


def find_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that a glob matches."""
    files, at = hadoop_path(spark, pattern)
    return sorted(s.getPath().getName() for s in files.globStatus(at) or [] if s.isDirectory())


def table_files(spark: SparkSession, path) -> list[str]:
    """The files of a table given as file, folder, glob or list of these; markers such as _SUCCESS are none."""
    if isinstance(path, (list, tuple)):
        return [f for p in path for f in table_files(spark, p)]
    files, at = hadoop_path(spark, path)
    found = []
    for status in files.globStatus(at) or []:
        inside = files.listStatus(status.getPath()) if status.isDirectory() else [status]
        named = [s.getPath() for s in inside if s.isFile()]
        found += [p.toString() for p in named if not status.isDirectory() or p.getName()[0] not in "._"]
    return sorted(found)


def escaped(path: str) -> str:
    """Readers treat these characters in a path as a glob."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def header_cells(spark: SparkSession, path: str) -> list[str]:
    """Cells of a CSV file's first line that is not empty; only that line is read, without a Spark job."""
    jvm = spark.sparkContext._jvm
    files, at = hadoop_path(spark, path)
    stream = files.open(at)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.lstrip("\ufeff").strip():
            line = lines.readLine()
    finally:
        stream.close()
    return next(csv.reader(io.StringIO(line.removeprefix("\ufeff")))) if line is not None else []


def distinct_names(cells: list[str]) -> list[str]:
    """Column names: a repeated cell gets a number, an empty one its place."""
    taken, seen, names = set(cells), Counter(), []
    for place, cell in enumerate(cells):
        name = base = cell or f"Unnamed: {place}"
        while name in names or (name != base and name in taken):
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        names.append(name)
    return names


def by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files of equal headers; files without one are left out."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        if cells := header_cells(spark, path):
            groups.setdefault(tuple(cells), []).append(path)
    return groups
