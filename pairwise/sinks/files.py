"""Writers: ordered CSV, CSV per group, JSON records."""

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairwise.operators import assemble
from pairwise.operators.consensus import by_score
from pairwise.params import ConsensusParams
from pairwise.session import exact_names, stage
from pairwise.sinks import tables
from pairwise.sinks.report import report
from pairwise.sources.listing import escaped, header_cells, table_files
from pairwise.sources.predictions import KEYS, OWN
from pairwise.sources.quoted import numbered, scan_quoted

# Without these Spark writes "" for an empty text, escapes quotes with a backslash and trims cells.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), bom: bool = False) -> None:
    """``bom``: every file begins with a byte order mark, by which spreadsheets know that it is UTF-8."""
    if bom:  # part of the header's first cell
        first = next(c for c in df.columns if c not in partition_by)
        df = df.withColumnRenamed(first, f"{BYTE_ORDER_MARK}{first}")
    writer = df.write.mode("errorifexists").options(**CSV_OPTIONS)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


FILE_BYTES = 128 << 20


def planned(df: DataFrame, keys: list[str], file_bytes: int = FILE_BYTES) -> DataFrame:
    """Deal rows to the tasks of a partitioned write, so that a key gets as many files as its bytes ask for.

    The bytes of each key are counted first. A key over ``file_bytes`` has bytes / file_bytes tasks of its own,
    among which its rows are dealt by their hash; smaller keys share tasks, filled in the order of the keys.
    The plan has one row for each key. Rows that are equal in all columns go to one file.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    line = F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    counted = df.groupBy(*keys).agg(F.sum(F.octet_length(line) + 1).alias("_bytes"))
    files = F.ceil(F.col("_bytes") / file_bytes)
    order = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    large = F.when(files > 1, files).otherwise(0)
    small = F.when(files > 1, 0).otherwise(F.col("_bytes"))
    before = counted.select(
        *keys, files.alias("_files"),
        F.coalesce(F.sum(large).over(order), F.lit(0)).alias("_large"),
        F.floor(F.coalesce(F.sum(small).over(order), F.lit(0)) / file_bytes).alias("_shared"),
    )
    plan = stage(before, "file-plan")
    tasks = plan.agg(F.sum(F.when(F.col("_files") > 1, F.col("_files")).otherwise(0)), F.max("_shared")).first()
    own, shared = tasks[0] or 0, (tasks[1] or 0) + 1
    first = F.when(F.col("_files") > 1, F.col("_large")).otherwise(own + F.col("_shared"))
    named = plan.select(*[F.col(k).alias(f"_{k}") for k in keys], "_files", first.alias("_first"))
    same = [df[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    place = F.col("_first") + F.pmod(F.xxhash64(*columns), F.col("_files"))
    placed = df.join(named, same).withColumn("_task", place.cast("int"))
    return placed.repartitionById(own + shared, F.col("_task")).select(*columns)


def write_json(df: DataFrame, path: str) -> None:
    """A handful of records as JSON lines."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def with_run(df: DataFrame, **values: str) -> DataFrame:
    """Add the time of the run and any texts that describe it."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return df.select("*", now.alias("run_time"), *[F.lit(v).alias(k) for k, v in values.items()])


ROWS_PER_FILE = 50_000


def in_row_order(
    rows: DataFrame, rows_per_file: int = ROWS_PER_FILE, last: int | None = None
) -> DataFrame:
    """Place rows so that the part files, read by name, give the input order.

    Row numbers are dense, so the target file follows from the number itself: one shuffle and no
    sampling pass over the wide rows. ``last`` is the highest row number, if known.
    """
    if last is None:
        last = rows.agg(F.max("row_no")).first()[0] or 0
    n_files = max(1, math.ceil(last / rows_per_file))
    target = F.floor((F.col("row_no") - 1) / rows_per_file).cast("int")
    return rows.repartitionById(n_files, target).sortWithinPartitions("row_no")


def write_matrices(
    assembled: DataFrame,
    path: str,
    flagged: bool = False,
    last: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Combined and detailed feature tables in input order.

    ``flagged`` selects the older layouts and needs the uniqueness flags. Rows are joined and placed
    once, with their vectors as arrays, and kept on the executors' disks for the second table; the
    write lays out the columns. ``last`` is the highest row number, if known.
    """
    ordered = in_row_order(assembled, rows_per_file, last).persist(StorageLevel.DISK_ONLY)
    detailed: list[Column] = assemble.flagged_columns() if flagged else assemble.detailed_columns()
    try:
        write_csv(ordered.select(detailed), f"{path}/detailed_features")
        write_csv(ordered.select(assemble.combined_columns(flagged)), f"{path}/combined_features")
    finally:
        ordered.unpersist()


def written_rows(spark: SparkSession, path: str, flagged: bool = False) -> DataFrame:
    """``row_no, accession, compound_cid, position`` of a written detailed table, read back.

    The position is the line's place in the part files, read by name.
    """
    number = "Row_Number" if flagged else "Original_Row_Number"
    folder = f"{path}/detailed_features"
    parts = table_files(spark, folder)
    header = header_cells(spark, parts[0]) if parts else []
    wanted = {"row_no": number, "accession": "Protein_Accession", "compound_cid": "Compound_CID"}
    if not header:
        return spark.createDataFrame([], "row_no long, accession string, compound_cid string, position long")
    places = {name: header.index(column) for name, column in wanted.items()}
    # a compound string may hold line breaks
    scanned, totals = scan_quoted(spark, [escaped(p) for p in parts], len(header), places)
    return numbered(scanned, totals, "position", list(wanted)).withColumns(
        {
            "row_no": F.col("row_no").cast("long"),
            "accession": F.coalesce("accession", F.lit("")),
            "compound_cid": F.coalesce("compound_cid", F.lit("")),
        }
    )


def write_order(placed: DataFrame, path: str, last: int | None = None) -> None:
    """Order verification of output rows with their ``position``, one line per row."""
    checked = tables.order_check(placed).withColumnRenamed("Position", "row_no")
    ordered = in_row_order(checked, last=last).withColumnRenamed("row_no", "Position")
    write_csv(ordered, f"{path}/order_verification")


def _by_strategy(df: DataFrame, *ties: str) -> DataFrame:
    """Range-sort by strategy and score: files of a strategy, read by name, are in score order.

    ``ties`` and a hash of the row are part of the key, so the rows of a frequent pair, which have one
    score, spread over many ranges.
    """
    spread = F.xxhash64(*df.columns)
    return df.orderBy("strategy", *by_score(F.col("score")), *ties, spread).drop("score")


NUMBERS = ["positive_ratio", "avg_probability_0", "avg_probability_1", "avg_confidence"]


def _write_summary(stats: DataFrame, params: ConsensusParams, path: str, bom: bool) -> None:
    frame = _by_strategy(tables.export_basic(stats, params))
    frame = frame.withColumns(dict(zip(NUMBERS, tables.fixed(NUMBERS))))
    write_csv(frame, f"{path}/summary", ("strategy",), bom)


def _write_parameters(
    stats, predictions, params: ConsensusParams, kind: str, path: str, data_source: str | None
) -> None:
    record = tables.export_parameters(stats, predictions, params, kind)
    write_json(with_run(record, data_source=data_source or ""), f"{path}/parameters")


def write_basic(
    stats: DataFrame,
    predictions: DataFrame,
    params: ConsensusParams,
    path: str,
    data_source: str | None = None,
    bom: bool = False,
):
    """One CSV folder per strategy; a strategy without pairs gets none. ``data_source``: the run's folder."""
    _write_summary(stats, params, path, bom)
    _write_parameters(stats, predictions, params, "basic", path, data_source)


def write_detailed(
    stats: DataFrame,
    predictions: DataFrame,
    params: ConsensusParams,
    path: str,
    data_source: str | None = None,
    bom: bool = False,
):
    """Summaries as in ``write_basic`` and one row per pair and model."""
    _write_summary(stats, params, path, bom)
    # staged: the sort samples its input, which would run the join twice
    selected = stage(tables.export_detailed(stats, predictions, params), "detailed")
    detail = _by_strategy(selected, "model_type", "model_name")
    text = [
        "probability_0",
        "probability_1",
        "confidence",
        "avg_probability_1",
        "avg_confidence",
        "positive_ratio",
    ]
    value = F.col("prediction")
    plain = F.when(value == F.rint(value), F.format_string("%.0f", value.cast("double")))
    label = plain.otherwise(value.cast("string"))
    detail = detail.withColumns({**dict(zip(text, tables.fixed(text))), "prediction": label})
    write_csv(detail, f"{path}/detailed", ("strategy",), bom)
    _write_parameters(stats, predictions, params, "detailed", path, data_source)


def write_models(
    raw_models: list[DataFrame],
    combined: DataFrame,
    stats: DataFrame,
    params: ConsensusParams,
    path: str,
    data_source: str | None = None,
    file_bytes: int = FILE_BYTES,
):
    """Every model's original columns in its own folder, and all models in one table.

    ``raw_models`` has one frame per file header, so a model's folder keeps its own columns. Where a
    file has columns named like the model keys, the folders are named ``of_model_type`` and so on. A model
    gets one file for each ``file_bytes`` of its rows.
    """
    safe = F.replace("model_type", F.lit("/"), F.lit("_"))
    with exact_names(combined.sparkSession):
        for i, frame in enumerate(raw_models):
            named, keys = frame.withColumn("model_type", safe), KEYS
            if set(OWN) & set(frame.columns):
                keys = [f"of_{k}" for k in KEYS]
                named = named.withColumnsRenamed(dict(zip(KEYS, keys))).withColumnsRenamed(dict(zip(OWN, KEYS)))
            write_csv(planned(named, keys, file_bytes), f"{path}/models/format-{i}", tuple(keys))
        write_csv(combined, f"{path}/all_predictions_combined")
    meanings = tables.column_meanings(combined.sparkSession, combined.columns)
    write_csv(meanings.coalesce(1), f"{path}/column_dictionary")
    _write_parameters(stats, combined, params, "complete", path, data_source)


def write_report(
    stats: DataFrame,
    predictions: DataFrame,
    params: ConsensusParams,
    path: str,
    data_source: str | None = None,
):
    write_csv(report(stats, predictions, params, data_source).orderBy("section", "ord"), path)
