"""Run directories: latest prediction run, model summary, resumable feature runs."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairwise.sources.catalogue import discovered_files
from pairwise.sources.listing import find_folders

RUN_PREFIX = "batch_prediction_"
SUMMARY_FILE = "prediction_summary.json"
PREDICTION_SUFFIX = "_prediction.csv"


def decoded_path(path: Column) -> Column:
    """File paths arrive percent-encoded; a plus sign in them is a plus sign."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def path_part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, value`` with one row per whole file; empty if nothing matches."""
    try:
        texts = spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, value string")
    return texts.select(decoded_path(F.col("_metadata.file_path")).alias("path"), "value")


def latest_of(names: DataFrame, column: str) -> DataFrame:
    """The greatest run name among those with the run prefix."""
    return names.filter(F.col(column).startswith(RUN_PREFIX)).agg(F.max(column).alias("latest_run"))


def latest_run(spark: SparkSession, base: str) -> str | None:
    """Path of the newest run below ``base``, by name."""
    root = base.rstrip("/")
    names = find_folders(spark, f"{root}/{RUN_PREFIX}*")
    return f"{root}/{max(names)}" if names else None


def summary_models(summaries: DataFrame, text: str) -> DataFrame:
    """``model_type, model_name, model_dir`` from run summaries; unreadable JSON gives no rows.

    Only the keys of the two levels count; the inner values may be anything.
    """
    types = F.from_json(F.col(text), "map<string,string>")
    return (
        summaries.select(F.explode(types).alias("model_type", "_models"))
        .select(
            "model_type",
            F.explode(F.from_json("_models", "map<string,string>")).alias("model_name", "_value"),
        )
        .select(
            "model_type",
            "model_name",
            F.replace("model_type", F.lit("/"), F.lit("_")).alias("model_dir"),
        )
    )


def names_types(summaries: DataFrame, text: str) -> bool:
    """Is there a summary that names any model type? Then it decides what is read."""
    types = F.from_json(F.col(text), "map<string,string>")
    return not summaries.filter(F.size(types) > 0).isEmpty()


def summary_texts(spark: SparkSession, run_dir: str) -> DataFrame:
    """The run's summary file as text; empty without one."""
    return read_texts(spark, f"{run_dir.rstrip('/')}/{SUMMARY_FILE}")


def discovered_models(spark: SparkSession, run_dir: str) -> DataFrame:
    """``model_dir, model_name, path, bytes, header, error`` of each prediction file one level below the run."""
    found = discovered_files(spark, run_dir, PREDICTION_SUFFIX)
    name = F.replace("name", F.lit(PREDICTION_SUFFIX), F.lit(""))
    return found.select(F.col("folder").alias("model_dir"), name.alias("model_name"), "path", "bytes", "header", "error")


PROGRESS_SCHEMA = """
    start_time string, proteins_processed long, compounds_processed long, total_proteins long,
    total_compounds long, protein_features_completed array<string>,
    compound_features_completed array<string>, completed boolean, last_update string
"""


def resumable_runs(spark: SparkSession, base: str) -> DataFrame:
    """Feature runs below ``base`` with their status and counts, sorted by name."""
    pattern = f"{base.rstrip('/')}/*_features_*"
    run = F.regexp_extract("path", r"/([^/]*_features_[^/]*)/", 1).alias("run_dir")
    names = [(name,) for name in find_folders(spark, pattern)]
    runs = spark.createDataFrame(names, "run_dir string")
    records = read_texts(spark, f"{pattern}/progress.json").select(run, "value")
    progress = records.select(
        "run_dir", F.from_json("value", PROGRESS_SCHEMA).alias("p"), F.lit(True).alias("_present")
    )
    done = F.coalesce("p.completed", F.lit(False))
    status = (
        F.when(F.col("_present").isNull(), "no file").when(done, "complete").otherwise("incomplete")
    )
    counts = ["proteins_processed", "total_proteins", "compounds_processed", "total_compounds"]
    return (
        runs.join(progress, "run_dir", "left")
        .select(
            "run_dir",
            status.alias("status"),
            *[F.coalesce(F.col(f"p.{c}"), F.lit(0)).alias(c) for c in counts],
        )
        .orderBy("run_dir")
    )
