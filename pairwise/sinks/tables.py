"""Frames behind every output file."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairwise.constants import (
    DESCRIPTOR_DIM,
    DESCRIPTOR_GROUPS,
    DESCRIPTORS,
    MAX_LAG,
    NEGATIVE_LABEL,
    POSITIVE_LABEL,
    PROFILE_DIM,
    SEQUENCE_DIM,
)
from pairwise.functions.names import compound_names, profile_names, sequence_names
from pairwise.operators import consensus, entities
from pairwise.operators.ordinal import with_positions
from pairwise.operators.pairs import PAIR, export_totals
from pairwise.params import ConsensusParams

SUMMARY = [
    *PAIR,
    "total_models",
    "positive_predictions",
    "negative_predictions",
    "positive_ratio",
    "avg_probability_0",
    "avg_probability_1",
    "avg_confidence",
]


def fixed(columns: list[str], digits: int = 4) -> list[Column]:
    """Columns as text with fixed decimals, for the sink."""
    return [F.format_string(f"%.{digits}f", F.col(c)).alias(c) for c in columns]


def export_basic(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    """Pair summaries per strategy; ``score`` carries the order inside a strategy."""
    return consensus.memberships(stats, params).select("strategy", "score", *SUMMARY)


def export_detailed(
    stats: DataFrame, predictions: DataFrame, params: ConsensusParams
) -> DataFrame:
    """One row per (strategy, pair, model), pair averages repeated.

    Predictions are joined to the selected pairs once and fanned out to strategies afterwards; a
    pair with very many predictions is split by the adaptive skew join.
    """
    conditions = consensus.predicates(params)
    scores = consensus.scores()
    # A pair carries its strategies as bits, which compile to a few instructions; a list of names and scores is
    # built by interpreted code for every pair, and sorted and joined as a wide row.
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    selected = stats.select(
        *PAIR, "avg_probability_1", "avg_confidence", "positive_ratio", reduce(add, bits).alias("_hits")
    )
    # for each pattern of bits the numbers of the strategies; a pair of none gives no row
    numbers = [[F.lit(i) for i in range(len(bits)) if pattern >> i & 1] for pattern in range(1 << len(bits))]
    of_pattern = F.array(*[F.array(*found).cast("array<int>") for found in numbers])
    fanned = predictions.join(selected, PAIR).select("*", F.explode(F.get(of_pattern, F.col("_hits"))).alias("_nth"))
    label = F.when(F.col("prediction") == 1, POSITIVE_LABEL).otherwise(NEGATIVE_LABEL)
    return fanned.select(
        F.coalesce(*[F.when(F.col("_nth") == i, n) for i, n in enumerate(conditions)]).alias("strategy"),
        F.coalesce(*[F.when(F.col("_nth") == i, scores[n]) for i, n in enumerate(conditions)]).alias("score"),
        *PAIR,
        "model_type",
        "model_name",
        "prediction",
        label.alias("prediction_label"),
        "probability_0",
        "probability_1",
        "confidence",
        "avg_probability_1",
        "avg_confidence",
        "positive_ratio",
    )


def export_parameters(
    stats: DataFrame, predictions: DataFrame, params: ConsensusParams, export_type: str
) -> DataFrame:
    """One row: settings and totals of an export."""
    pairs = stats.agg(F.count("*").alias("pairs"), F.lit(0).alias("models"))
    models = export_totals(predictions).select(F.lit(0).alias("pairs"), "models")
    return (
        pairs.unionByName(models)
        .agg(
            F.sum("pairs").alias("total_compounds_analyzed"), F.sum("models").alias("total_models")
        )
        .select(
            F.lit(export_type).alias("export_type"),
            F.lit(params.min_consensus).alias("min_consensus_models"),
            F.lit(params.probability).alias("probability_threshold"),
            F.lit(params.confidence).alias("confidence_threshold"),
            "total_compounds_analyzed",
            "total_models",
        )
    )


# --- fixed values: meaning of the columns of the full export ------------------------------------
COLUMN_MEANING = {
    "protein_id": "protein id",
    "compound_id": "compound id",
    "prediction": "predicted class (0 no interaction, 1 interaction)",
    "probability_0": "probability of no interaction",
    "probability_1": "probability of interaction",
    "confidence": "confidence of the prediction",
    "model_type": "model type",
    "model_name": "model name",
}
# ------------------------------------------------------------------------------------------------


def column_meanings(spark: SparkSession, columns: list[str]) -> DataFrame:
    """``position, column, description`` of the full export's known columns."""
    known = [c for c in columns if c in COLUMN_MEANING]
    rows = [(i, c, COLUMN_MEANING[c]) for i, c in enumerate(known, start=1)]
    return spark.createDataFrame(rows, "position int, column string, description string")


def feature_names(spark: SparkSession, by_lag: bool = False) -> DataFrame:
    """``block, idx, name, descriptor_group`` of all 335 features."""
    groups = {n: group for group, members in DESCRIPTOR_GROUPS.items() for n in members}
    names = [
        *[("sequence", i, n, None) for i, n in enumerate(sequence_names())],
        *[("profile", i, n, None) for i, n in enumerate(profile_names(by_lag))],
        *[
            ("compound", i, n, groups.get(d))
            for i, (n, d) in enumerate(zip(compound_names(), DESCRIPTORS))
        ],
    ]
    return spark.createDataFrame(
        names, "block string, idx int, name string, descriptor_group string"
    )


# --- fixed values: what the feature blocks hold and how the profiles were searched ----------------
BLOCK_MEANING = {
    "sequence": "Pseudo Amino Acid Composition features",
    "profile": "Pseudo Position-Specific Scoring Matrix features",
    "compound": "Comprehensive molecular descriptors for compounds",
}
SEARCH_ITERATIONS = 3
SEARCH_EVALUE = 0.001
OUTPUT_FORMAT = "Protein_Accession + Protein_Features + Compound_CID + Compound_Features + Label"
# --------------------------------------------------------------------------------------------------


def feature_settings(spark: SparkSession) -> DataFrame:
    """One row: how the features were extracted, and what each block holds."""
    sizes = {"sequence": SEQUENCE_DIM, "profile": PROFILE_DIM, "compound": DESCRIPTOR_DIM}
    blocks = [
        F.struct(F.lit(text).alias("description"), F.lit(sizes[b]).alias("dimensions")).alias(b)
        for b, text in BLOCK_MEANING.items()
    ]
    return spark.range(1).select(
        F.lit(OUTPUT_FORMAT).alias("output_format"),
        F.lit("Separate deduplication for proteins and compounds").alias("deduplication_strategy"),
        F.lit(MAX_LAG).alias("sequence_lags"),
        F.lit(MAX_LAG).alias("profile_lags"),
        F.lit(SEARCH_ITERATIONS).alias("search_iterations"),
        F.lit(SEARCH_EVALUE).alias("search_evalue"),
        F.lit(sum(sizes.values())).alias("total_features"),
        *blocks,
    )


def order_verification(rows: DataFrame) -> DataFrame:
    """Positions in row order, original row numbers and whether they agree."""
    narrow = rows.select("row_no", "accession", "compound_cid")
    return order_check(with_positions(narrow, "row_no", "position"))


def order_check(placed: DataFrame) -> DataFrame:
    """Output position, original row number and whether they agree."""
    return placed.select(
        F.col("position").alias("Position"),
        F.col("row_no").alias("Original_Row_Number"),
        F.col("accession").alias("Protein_Accession"),
        F.col("compound_cid").alias("Compound_CID"),
        F.when(F.col("position") == F.col("row_no"), "YES").otherwise("NO").alias("Order_OK"),
    )


def order_is_intact(rows: DataFrame) -> bool:
    """Row numbers are exactly 1..n."""
    found = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("row_no").alias("distinct"),
        F.min("row_no").alias("low"),
        F.max("row_no").alias("high"),
    ).first()
    n = found["n"]
    return n == 0 or (found["distinct"], found["low"], found["high"]) == (n, 1, n)


def order_passed(placed: DataFrame, expected: int) -> bool:
    """Are there ``expected`` output rows, each at the position of its row number?"""
    n, wrong = placed.agg(
        F.count("*"), F.count_if(~F.col("position").eqNullSafe(F.col("row_no")))
    ).first()
    return n == expected and not wrong


def processing_stats(rows: DataFrame) -> DataFrame:
    """Totals of a feature run and the vector sizes; needs ``pssm_available``."""
    sizes = {
        "protein_pseaac": SEQUENCE_DIM,
        "protein_psepssm": PROFILE_DIM,
        "compound": DESCRIPTOR_DIM,
        "total": SEQUENCE_DIM + PROFILE_DIM + DESCRIPTOR_DIM,
    }
    nested = F.struct(*[F.lit(n).alias(name) for name, n in sizes.items()])
    return entities.run_totals(rows, F.col("pssm_available")).withColumn("feature_dimensions", nested)
