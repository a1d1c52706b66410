"""CSV files whose quoted cells hold line breaks, read in parallel.

A line break inside quotes does not end a record, and whether a place is inside quotes depends on everything
before it, so a plain reader makes such a file one task. Here the file is scanned as physical lines, which
Spark splits anywhere:

1. Every split runs the quote automaton over its lines from both states that a line can begin in, between
   records and inside quotes. That gives a function from the state at its start to the state at its end, and
   the number of records that begin in it for either start.
2. The functions are composed over the splits of each file by running sums: a split that ends in the same
   state from both starts fixes it, every other one keeps or turns it. Each split then knows the state it
   begins in, and how many records begin before it.
3. Every split is read again from its first true record on. Lines before that, and a record still open at
   its end, are fragments of one record; the few fragments are put together by record number.

The row numbers of step 2 are the input order; they need no further pass. A record may span any number of
splits. Lines end in LF or CRLF; a line break inside quotes is read as LF.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairwise.session import stage

OPEN, QUOTED = 0, 1  # states at the begin of a line: between records, inside quotes
MOST_SPLITS = 200_000  # splits whose table is broadcast; 128 MB each make 25 TB, and the table about 20 MB

_QUOTED_REST = re.compile(rb'(?:[^"]++|"")*+"[^,]*+(,)?')
_FIELD = re.compile(rb'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)(,)?')

_SPLIT = "file string, block bigint, from_open int, from_quoted int, begin_open bigint, begin_quoted bigint"
_PART = "file string, record bigint, block bigint, closed boolean, text string"


def line_end(line: bytes, state: int) -> int:
    """The state behind a line that begins in ``state``."""
    at = 0
    if state == QUOTED:
        found = _QUOTED_REST.match(line)
        if not found:
            return QUOTED
        if not found[1]:
            return OPEN
        at = found.end()
    while True:
        found = _FIELD.match(line, at)
        if not found[1]:
            return OPEN if found.end() == len(line) else QUOTED
        at = found.end()


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, line: physical lines in the order of their split; a line keeps its carriage return."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    where = F.col("_metadata")
    return lines.select(where["file_path"].alias("file"), where["file_block_start"].alias("block"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]):
    """The lines of each split, in pieces: (file, block), the piece, which of its lines hold a quote, which are blank."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, lines = (batch.column(k) for k in range(3))
        quotes = pc.match_substring(lines, '"').to_pylist()
        blank = pc.is_in(lines, pa.array(["", "\r"])).to_pylist()
        keys = list(zip(files.to_pylist(), blocks.to_pylist(), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], slice(start, i), lines, quotes, blank, batch
                start = i


def _automaton(batches):
    """One row for each split."""
    done, key = [], None
    ends, begun = [OPEN, QUOTED], [0, 0]
    for own, piece, lines, quotes, blank, _ in _runs(batches):
        if own != key:
            if key:
                done.append((*key, *ends, *begun))
            key, ends, begun = own, [OPEN, QUOTED], [0, 0]
        for i in range(piece.start, piece.stop):
            line = lines[i].as_py().encode() if quotes[i] else None
            for k in (0, 1):
                begun[k] += ends[k] == OPEN and not blank[i]
                if line is not None:
                    ends[k] = line_end(line, ends[k])
    if key:
        done.append((*key, *ends, *begun))
    names = ["file", "block", "from_open", "from_quoted", "begin_open", "begin_quoted"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*done, strict=True)) or [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def split_starts(splits: DataFrame) -> DataFrame:
    """file, block, state (at the start of the split), before (records that begin before it), rows (of the split).

    One row per split, so a file's window holds its bytes / 128 MB rows.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_open") == F.col("from_quoted")
    turned = splits.withColumn("turns", F.sum(F.when(fixed, 0).otherwise(F.col("from_open"))).over(order))
    # the last split that fixes the state, seen through the turns after it
    known = F.last(F.when(fixed, (F.col("from_open") + F.col("turns")) % 2), ignorenulls=True).over(before)
    behind = F.coalesce(F.last("turns").over(before), F.lit(0))
    stated = turned.withColumn("state", (F.coalesce(known, F.lit(OPEN)) + behind) % 2)
    rows = F.when(F.col("state") == OPEN, F.col("begin_open")).otherwise(F.col("begin_quoted"))
    counted = stated.withColumn("rows", rows)
    return counted.select("file", "block", "state", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), "rows")


def _assembler(batches):
    """Whole records of each split, and the parts of those that cross its borders."""
    key, state, record, held = None, OPEN, 0, []
    out = []

    def flush(closed: bool):
        nonlocal held
        if held:
            out.append((*key[:1], record, key[1], closed, "\n".join(held)))
            held = []

    for own, piece, lines, quotes, blank, batch in _runs(batches):
        if own != key:
            flush(False)
            key, at = own, piece.start
            state, record = batch.column("state")[at].as_py(), batch.column("before")[at].as_py()
            inherited = state == QUOTED  # the first record here began in an earlier split
        for i in range(piece.start, piece.stop):
            if state == OPEN:
                if blank[i]:
                    continue
                record, inherited = record + 1, False
            line = lines[i].as_py().removesuffix("\r")
            held.append(line)
            if quotes[i]:
                state = line_end(line.encode(), state)
            if state == OPEN:
                flush(not inherited)
        if len(out) >= 4096:
            yield _parts(out)
            out = []
    flush(False)
    yield _parts(out)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["file", "record", "block", "closed", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records as ``file, record (from 1), text``, and the table of the splits."""
    splits = stage(read_lines(spark, paths).mapInArrow(_automaton, _SPLIT), "csv-splits")
    starts = stage(split_starts(splits), "csv-starts")
    where = starts.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "state", "before")
    lines = read_lines(spark, paths)
    if splits.count() <= MOST_SPLITS:  # the join then keeps the order of the scan
        joined = _at_split(lines, F.broadcast(where))
    else:
        numbered = lines.withColumn("_n", F.monotonically_increasing_id())
        joined = _at_split(numbered, where).repartition("file", "block").sortWithinPartitions("file", "block", "_n")
    ordered = joined.select("file", "block", "line", "state", "before")
    parts = stage(ordered.mapInArrow(_assembler, _PART), "csv-records")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    crossing = parts.filter("not closed").groupBy("file", "record").agg(F.array_join(pieces, "\n").alias("text"))
    return parts.filter("closed").select("file", "record", "text").unionByName(crossing), starts


def _at_split(lines: DataFrame, where: DataFrame) -> DataFrame:
    return lines.join(where, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))


def parse_records(records: DataFrame, width: int, columns: dict[str, int], strict: bool = True) -> DataFrame:
    """Cells of ``text`` by place, beside the other columns. A record that lacks cells fails if ``strict``."""
    names = [f"_c{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in [*names, "_raw"])
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}
    parsed = records.withColumn("_cells", F.from_csv("text", schema, options))
    cells = {n: F.col(f"_cells.{n}") for n in names}
    if strict:
        raw = F.col("_cells._raw")
        bare = F.regexp_replace(raw, '"[^"]*+"', "")
        short = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 < width
        refused = F.raise_error(F.concat(F.lit("record with missing cells: "), raw)).cast("string")
        cells = {n: F.when(short, refused).otherwise(c) for n, c in cells.items()}
    kept = [c for c in records.columns if c != "text"]
    return parsed.select(*kept, *[cells[f"_c{i}"].alias(name) for name, i in columns.items()])


def scan_quoted(spark: SparkSession, paths: list[str], width: int, columns: dict[str, int], strict: bool = True):
    """Records below the header as ``file, record (from 1)`` and the wanted cells; and ``file, rows``."""
    records, starts = read_records(spark, paths)
    below = records.filter("record > 1").withColumn("record", F.col("record") - 1)
    totals = starts.groupBy("file").agg(F.greatest(F.sum("rows") - 1, F.lit(0)).alias("rows"))
    return parse_records(below, width, columns, strict), totals


def numbered(rows: DataFrame, totals: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The record's number over all files in the order of their names, as ``name``, and the wanted columns."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(stage(offsets, "file-offsets"), "file")
    return joined.select((F.col("record") + F.col("_before")).alias(name), *columns)
