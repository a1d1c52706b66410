"""Labelled protein-compound pairs."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairwise.constants import COLUMN_ALIASES, REQUIRED_FIELDS
from pairwise.functions.scalar import strip
from pairwise.operators.ordinal import FILE_POSITION, with_file_position, with_row_numbers
from pairwise.sources.listing import by_header, escaped, table_files
from pairwise.sources.quoted import numbered, scan_quoted


def resolve_columns(header: list[str]) -> dict[str, str | None]:
    """Logical field -> header name; exact match, the first alias in the list wins."""
    present = set(header)
    return {
        field: next((name for name in names if name in present), None)
        for field, names in COLUMN_ALIASES.items()
    }


def checked_columns(header: list[str]) -> dict[str, str | None]:
    """``resolve_columns``, refusing a header that lacks a required field."""
    mapping = resolve_columns(header)
    missing = [field for field in REQUIRED_FIELDS if mapping[field] is None]
    if missing:
        raise ValueError(f"required columns not found: {missing}; available: {header}")
    return mapping


def select_fields(df: DataFrame) -> DataFrame:
    """Project any accepted column names onto the five logical fields; label is optional."""
    return df.select(
        *[
            F.col(f"`{actual}`").alias(field) if actual else F.lit("").alias(field)
            for field, actual in checked_columns(df.columns).items()
        ]
    )


def clean_fields(df: DataFrame) -> DataFrame:
    """Strip every field and upper-case the sequence; a missing cell is an empty text, ids included."""
    cleaned = {c: F.coalesce(strip(F.col(c)), F.lit("")) for c in COLUMN_ALIASES}
    return df.withColumns({**cleaned, "sequence": F.upper(cleaned["sequence"])})


def scan_csv(
    spark: SparkSession,
    path,
    width: int,
    columns: dict[str, int],
    strict: bool = True,
) -> DataFrame:
    """Text columns by position: ``columns`` maps the wanted names to places in the header.

    Cells beyond the header are dropped. A line that lacks cells fails if ``strict``, else it is
    filled with NULL.
    """
    names = [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_raw"]])
    options = {"header": True, "escape": '"', "columnPruning": False}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}
    rows = spark.read.schema(schema).options(**options).csv(path)
    if strict:
        bare = F.regexp_replace("_raw", r'"(?:[^"]|"")*"', "")
        short = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 < width
        refused = F.raise_error(F.concat(F.lit("line with missing cells: "), F.col("_raw"))).cast("string")
        rows = rows.withColumns({n: F.when(short, refused).otherwise(F.col(n)) for n in names})
    wanted = [F.col(f"_c{i}").alias(name) for name, i in columns.items()]
    return rows.select(*wanted, F.col("_metadata").alias("_metadata"))


def read_interactions(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Rows of a CSV in file order with 1-based ``row_no``.

    Every file is read by its own header. ``multi_line`` accepts line breaks inside quotes; such files are
    split all the same (see ``sources.quoted``). A header cell holds no line break.
    """
    parts, totals = [], []
    for header, files in by_header(spark, table_files(spark, path)).items():
        found = {f: header.index(name) for f, name in checked_columns(list(header)).items() if name}
        paths = [escaped(p) for p in files]
        if multi_line:
            rows, counts = scan_quoted(spark, paths, len(header), found)
            totals.append(counts)
        else:
            rows = with_file_position(scan_csv(spark, paths, len(header), found))
        if "label" not in found:
            rows = rows.withColumn("label", F.lit(""))
        parts.append(rows.select(*["file", "record"] if multi_line else [FILE_POSITION], *COLUMN_ALIASES))
    if not parts:
        raise FileNotFoundError(f"no interaction file with a header in {path}")
    rows = clean_fields(reduce(DataFrame.unionByName, parts))
    if multi_line:
        return numbered(rows, reduce(DataFrame.unionByName, totals), "row_no", list(COLUMN_ALIASES))
    return with_row_numbers(rows)
