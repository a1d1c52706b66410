"""Consensus run: predictions in, filtered and ranked pairs and exports out."""

from pyspark.sql import DataFrame, SparkSession

from pairwise.operators.pairs import pair_stats
from pairwise.params import ConsensusParams
from pairwise.session import owned_staging, stage
from pairwise.sinks import files
from pairwise.sources.predictions import read_predictions, read_raw_models, union_models


def load_pairs(spark: SparkSession, run_dir: str | None = None, base: str | None = None):
    """Predictions of a run and their pair statistics, the latter staged for repeated use."""
    predictions = read_predictions(spark, run_dir, base)
    return predictions, stage(pair_stats(predictions), "pair-stats")


def run_exports(
    spark: SparkSession,
    run_dir: str,
    output: str,
    params: ConsensusParams = ConsensusParams(),
    bom: bool = False,
) -> DataFrame:
    """All exports and the report of one run; returns the pair statistics, which stay staged.

    ``bom``: the files of pairs begin with a byte order mark, for spreadsheets.
    """
    predictions, stats = load_pairs(spark, run_dir)
    with owned_staging(spark):
        files.write_basic(stats, predictions, params, f"{output}/basic", run_dir, bom)
        files.write_detailed(stats, predictions, params, f"{output}/detailed", run_dir, bom)
        raw = read_raw_models(spark, run_dir)
        files.write_models(raw, union_models(raw), stats, params, f"{output}/complete", run_dir)
        files.write_report(stats, predictions, params, f"{output}/report", run_dir)
    return stats
