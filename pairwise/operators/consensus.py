"""Consensus strategies over pair statistics: filters, counts, ranks, sweeps."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwise.constants import PRESETS, STRATEGIES
from pairwise.functions.scalar import at_least, count_where
from pairwise.operators.pairs import PAIR
from pairwise.params import ConsensusParams, sweep_thresholds

PROBABILITY = "avg_probability_1"
CONFIDENCE = "avg_confidence"


def predicates(p: ConsensusParams) -> dict[str, Column]:
    """Membership condition of each strategy."""
    total, positive = F.col("total_models"), F.col("positive_predictions")
    seen = total >= p.min_consensus
    backed = seen & (positive >= p.min_consensus)
    confident = at_least(CONFIDENCE, p.confidence)
    probable = at_least(PROBABILITY, p.probability)
    return {
        "all_positive": seen & (positive == total),
        "majority_positive": backed & (F.col("positive_ratio") > 0.5),
        "high_confidence": backed & confident,
        "high_probability": backed & probable,
        "custom_consensus": backed & confident & probable,
    }


def scores() -> dict[str, Column]:
    """Sort key of each strategy, highest first."""
    confidence, probability = F.col(CONFIDENCE), F.col(PROBABILITY)
    return {
        "all_positive": confidence,
        "majority_positive": confidence,
        "high_confidence": confidence,
        "high_probability": probability,
        "custom_consensus": (confidence + probability) / 2,
    }


def by_score(score: Column) -> list[Column]:
    """Descending score, NaN last, ties by the ids."""
    return [F.isnan(score), score.desc(), *map(F.col, PAIR)]


def matching(stats: DataFrame, strategy: str, params: ConsensusParams) -> DataFrame:
    """Pairs of one strategy with their ``score``, unordered."""
    return stats.filter(predicates(params)[strategy]).withColumn("score", scores()[strategy])


def select_strategy(stats: DataFrame, strategy: str, params: ConsensusParams) -> DataFrame:
    """Pairs of one strategy, best first."""
    return matching(stats, strategy, params).orderBy(*by_score(F.col("score")))


def memberships(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    """One row per (strategy, pair) with its ``score``; a single pass over the statistics."""
    conditions, keys = predicates(params), scores()
    hits = F.array(
        *[
            F.when(
                conditions[name], F.struct(F.lit(name).alias("strategy"), keys[name].alias("score"))
            )
            for name in STRATEGIES
        ]
    )
    return stats.select("*", F.inline(F.array_compact(hits)))


def top_by_strategy(stats: DataFrame, params: ConsensusParams, k: int = 20) -> DataFrame:
    """The best ``k`` pairs of every strategy, ranked from 1.

    The rank limit is applied inside each task before the shuffle, so the five groups stay small.
    """
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(*by_score(F.col("score"))))
    return memberships(stats, params).withColumn("rank", rank).filter(F.col("rank") <= k)


def top(stats: DataFrame, strategy: str, params: ConsensusParams, k: int = 20) -> DataFrame:
    return select_strategy(stats, strategy, params).limit(k)


def _counts(stats: DataFrame, conditions: list[tuple[tuple, Column]], header: str) -> DataFrame:
    """Count several conditions in one pass, one output row per condition.

    ``header`` is the DDL of the literal columns that come before the count.
    """
    names = [f"_c{i}" for i in range(len(conditions))]
    row = stats.agg(*[count_where(c).alias(n) for n, (_, c) in zip(names, conditions)])
    fields = [field.strip().split(" ") for field in header.split(",")]
    entries = [
        F.struct(
            *[F.lit(v).cast(kind).alias(f) for v, (f, kind) in zip(values, fields)],
            F.col(name).alias("pairs"),
        )
        for name, (values, _) in zip(names, conditions)
    ]
    return row.select(F.inline(F.array(*entries)))


def strategy_counts(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    conditions = predicates(params)
    return _counts(stats, [((n,), conditions[n]) for n in STRATEGIES], "strategy string")


def preset_comparison(stats: DataFrame, min_consensus: int = 2) -> DataFrame:
    """Size of the custom strategy under each preset."""
    rows = []
    for name in PRESETS:
        params = ConsensusParams.preset(name, min_consensus)
        values = (name, params.probability, params.confidence)
        rows.append((values, predicates(params)["custom_consensus"]))
    return _counts(stats, rows, "preset string, probability double, confidence double")


def threshold_counts(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    """Pairs over the probability threshold, the confidence threshold, and both."""
    probable = at_least(PROBABILITY, params.probability)
    confident = at_least(CONFIDENCE, params.confidence)
    return stats.agg(
        count_where(probable).alias("over_probability"),
        count_where(confident).alias("over_confidence"),
        count_where(probable & confident).alias("over_both"),
    )


def threshold_sweep(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    """Pairs with enough positives over each of ten thresholds, for both metrics."""
    enough = F.col("positive_predictions") >= params.min_consensus
    metrics = {"probability": PROBABILITY, "confidence": CONFIDENCE}
    rows = [
        ((name, t), enough & at_least(metric, t))
        for name, metric in metrics.items()
        for t in sweep_thresholds()
    ]
    return _counts(stats, rows, "metric string, threshold double")


def funnel(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    """Eight stages; "two positives" is a fixed 2, whatever the minimum consensus."""
    positive, member = F.col("positive_predictions"), predicates(params)
    stages = {
        "total": F.lit(True),
        "one_positive": positive > 0,
        "two_positives": positive >= 2,
        "majority_positive": member["majority_positive"],
        "high_probability": member["high_probability"],
        "high_confidence": member["high_confidence"],
        "all_positive": member["all_positive"],
        "custom_consensus": member["custom_consensus"],
    }
    rows = [((i, name), c) for i, (name, c) in enumerate(stages.items(), start=1)]
    return _counts(stats, rows, "stage int, name string")


ADVICE = [
    ("validate_all_positive_first", "Validate the pairs that all models agree on first."),
    ("high_confidence_second", "Take high-confidence pairs as the second choice."),
    ("filter_majority_further", "Many majority pairs: filter them further."),
]


def advice(stats: DataFrame, params: ConsensusParams) -> DataFrame:
    """Advice that the strategy sizes call for."""
    member = predicates(params)
    sizes = stats.agg(
        *[
            count_where(member[n]).alias(n)
            for n in ("all_positive", "high_confidence", "majority_positive")
        ]
    )
    everyone, confident = F.col("all_positive"), F.col("high_confidence")
    triggers = [everyone > 0, confident > everyone, F.col("majority_positive") > 50]
    lines = [
        F.when(
            trigger,
            F.struct(
                F.lit(i).alias("rule"), F.lit(code).alias("code"), F.lit(text).alias("advice")
            ),
        )
        for i, (trigger, (code, text)) in enumerate(zip(triggers, ADVICE), start=1)
    ]
    return sizes.select(F.inline(F.array_compact(F.array(*lines))))
