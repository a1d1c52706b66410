"""The analysis report as rows ``section, ord, key, value``."""

from pyspark.sql import Column, DataFrame, functions as F

from pairwise.constants import STRATEGIES
from pairwise.operators import consensus, distributions
from pairwise.operators.pairs import PAIR
from pairwise.params import ConsensusParams
from pairwise.sinks.tables import export_parameters

TOP = 20


def _rows(frame: DataFrame, section: Column, order: Column, key: Column, value: Column):
    return frame.select(
        section.alias("section"),
        order.cast("int").alias("ord"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
    )


def _unpivot(frame: DataFrame, section: Column, texts: dict[str, Column]) -> DataFrame:
    """One row per named text of every input row."""
    entries = [
        F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), text.alias("value"))
        for i, (key, text) in enumerate(texts.items(), start=1)
    ]
    long = frame.select(section.alias("section"), F.inline(F.array(*entries)))
    return long.select("section", F.col("ord").cast("int").alias("ord"), "key", "value")


def report(
    stats: DataFrame,
    predictions: DataFrame,
    params: ConsensusParams,
    data_source: str | None = None,
) -> DataFrame:
    """The data source if given, overview, strategy sizes, the top 20 of two strategies, distribution figures, advice.

    The statistics are read once per section: pass a staged table.
    """
    counts = ["total_compounds_analyzed", "total_models", "min_consensus_models"]
    thresholds = ["probability_threshold", "confidence_threshold"]
    overview = _unpivot(
        export_parameters(stats, predictions, params, "report"),
        F.lit("1_overview"),
        {
            **{name: F.col(name).cast("string") for name in counts},
            **{name: F.format_string("%.3f", name) for name in thresholds},
            **({"data_source": F.lit(data_source)} if data_source else {}),
        },
    )

    strategy = F.col("strategy")
    position = F.array_position(F.array(*map(F.lit, STRATEGIES)), strategy)
    sizes = _rows(
        consensus.strategy_counts(stats, params),
        F.lit("2_strategies"),
        position,
        strategy,
        F.col("pairs"),
    )

    best = consensus.top_by_strategy(stats, params, TOP).filter(
        strategy.isin("all_positive", "high_confidence")
    )
    line = F.format_string("%s|%s|%.3f|%.3f", *PAIR, "avg_probability_1", "avg_confidence")
    top = _rows(best, F.concat(F.lit("3_"), strategy), F.col("rank"), F.col("rank"), line)

    figures = _unpivot(
        distributions.distribution_stats(stats).filter("metric <> 'ratio'"),
        F.concat(F.lit("4_"), "metric"),
        {name: F.format_string("%.4f", name) for name in ("mean", "median", "std", "min", "max")},
    )

    tips = consensus.advice(stats, params)
    advice = _rows(tips, F.lit("5_advice"), F.col("rule"), F.col("code"), F.col("advice"))

    result = overview
    for part in (sizes, top, figures, advice):
        result = result.unionByName(part)
    return result
