"""Per-model prediction tables, read into one long frame."""

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairwise.functions.scalar import number
from pairwise.session import exact_names, stage
from pairwise.sources.catalogue import hidden_lines, is_hidden
from pairwise.sources.interactions import scan_csv
from pairwise.sources.listing import distinct_names, escaped
from pairwise.sources.quoted import parse_records
from pairwise.sources.runs import (
    decoded_path,
    discovered_models,
    latest_run,
    names_types,
    summary_models,
    summary_texts,
)

KEYS = ["model_type", "model_name"]
OWN = [f"own_{k}" for k in KEYS]
DEFAULTED = ["probability_0", "probability_1", "confidence"]
DEFAULT_VALUE = 0.5

log = logging.getLogger(__name__)


def union_models(frames: list[DataFrame]) -> DataFrame:
    """All model tables by exact column name; a column that a table lacks is NULL there.

    Columns of a file that bear the names of the model's type and name give way to these.
    """
    with exact_names(frames[0].sparkSession):
        plain = [f.drop(*OWN) for f in frames]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plain)


def with_defaults(df: DataFrame) -> DataFrame:
    """0.5 where a whole column is absent; a missing cell of a present column is NaN."""
    cells = {
        name: F.coalesce(F.col(name).cast("double"), F.lit(float("nan")))
        if name in df.columns
        else F.lit(DEFAULT_VALUE)
        for name in DEFAULTED
    }
    return df.withColumns(cells)


def _typed(df: DataFrame) -> DataFrame:
    numeric = {c: number(F.col(c)) for c in ["prediction", *DEFAULTED] if c in df.columns}
    return df.withColumns(numeric)


def read_raw_models(spark: SparkSession, run_dir: str | None = None, base: str | None = None):
    """One frame per distinct file header, all columns as text, with model type and name.

    With a summary the models it names are read where their files exist, else every prediction
    file found. A file whose header cannot be read is logged and left out. Repeated and empty header
    cells get names of their own; columns named like the model keys are kept under ``OWN`` names.
    The executors read the headers; the driver gets one row per distinct header, with the paths that the
    scan of its files needs. Files whose names Spark's readers hide are read on the executors as well.
    """
    run_dir = run_dir or latest_run(spark, base)
    if run_dir is None:
        raise FileNotFoundError("no prediction run found")
    listed = stage(discovered_models(spark, run_dir), "catalogue")
    summary = summary_texts(spark, run_dir)
    if names_types(summary, "value"):
        models = listed.join(summary_models(summary, "value"), ["model_dir", "model_name"])
    else:
        models = listed.withColumn("model_type", F.col("model_dir"))
    for skipped in models.filter(F.coalesce(F.size("header"), F.lit(0)) < 1).toLocalIterator():
        log.warning("skipped %s: %s", skipped["path"], skipped["error"] or "no header")
    types = models.select(local_form(F.col("path")).alias("_path"), "model_type", "model_name")
    headers = models.filter(F.size("header") > 0).groupBy("header").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    frames = []
    for row in headers.orderBy(F.array_join("header", ",")).toLocalIterator():
        names = distinct_names(list(row["header"]))
        places = {f"own_{n}" if n in KEYS else n: i for i, n in enumerate(names)}
        frames += [_tagged(f, types, places) for f in _scans(spark, row["paths"], places)]
    if not frames:
        raise FileNotFoundError(f"no readable prediction file in {run_dir}")
    return frames


def _scans(spark: SparkSession, paths: list[str], places: dict[str, int]):
    """The cells of files of one header, with ``_path``."""
    shown = [escaped(p) for p in paths if not is_hidden(p)]
    hidden = [p for p in paths if is_hidden(p)]
    with exact_names(spark):
        if shown:
            rows = scan_csv(spark, shown, len(places), places, strict=False)
            yield rows.select(*_plain(places), decoded_path(F.col("_metadata.file_path")).alias("_path"))
        if hidden:
            lines = hidden_lines(spark, hidden).withColumnsRenamed({"path": "_path", "line": "text"})
            yield parse_records(lines, len(places), places, strict=False)


def _plain(places: dict[str, int]):
    return [F.col(f"`{c}`") for c in places]


def _tagged(rows: DataFrame, types: DataFrame, places: dict[str, int]) -> DataFrame:
    """Cells with the type and name of their file's model."""
    with exact_names(rows.sparkSession):
        named = rows.withColumn("_path", local_form(F.col("_path"))).join(types, "_path")
        return named.select(*_plain(places), "model_type", "model_name")


def local_form(path: Column) -> Column:
    """Paths of the local file system come with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_predictions(spark: SparkSession, run_dir: str | None = None, base: str | None = None):
    """Typed predictions of a run: keys, prediction, the two probabilities, confidence."""
    raw = read_raw_models(spark, run_dir, base)
    columns = [*KEYS, "protein_id", "compound_id", "prediction", *DEFAULTED]
    with exact_names(spark):
        frames = [with_defaults(_typed(f)).select(columns) for f in raw]
    return union_models(frames)
