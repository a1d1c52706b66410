"""Pair statistics over the predictions of all models."""

from pyspark.sql import Column, DataFrame, functions as F

from pairwise.functions.scalar import stable_mean

PAIR = ["protein_id", "compound_id"]


def pair_key() -> Column:
    return F.concat_ws("_", *PAIR)


def with_legacy_pair(predictions: DataFrame) -> DataFrame:
    """Rebuild the two ids by cutting the joined key at its first underscore.

    Ids with an underscore come back changed and different pairs may fall together. Off by
    default; only for results that must agree with such keys.
    """
    halves = F.split(pair_key(), "_", 2)
    return predictions.withColumns({"protein_id": halves[0], "compound_id": halves[1]})


def pair_stats(predictions: DataFrame, legacy_key: bool = False) -> DataFrame:
    """Counts and means per (protein, compound).

    One shuffle on the pair after partial aggregation; the list of predictions is not gathered.
    """
    if legacy_key:
        predictions = with_legacy_pair(predictions)
    total, positive = F.col("total_models"), F.col("positive_predictions")
    return (
        predictions.groupBy(*PAIR)
        .agg(
            F.count("*").alias("total_models"),
            F.count_if(F.col("prediction") == 1).alias("positive_predictions"),
            stable_mean(F.col("probability_1")).alias("avg_probability_1"),
            stable_mean(F.col("confidence")).alias("avg_confidence"),
        )
        .select(
            *PAIR,
            "total_models",
            "positive_predictions",
            (total - positive).alias("negative_predictions"),
            (positive / total).alias("positive_ratio"),
            (1 - F.col("avg_probability_1")).alias("avg_probability_0"),
            "avg_probability_1",
            "avg_confidence",
        )
    )


def model_list(predictions: DataFrame) -> DataFrame:
    """``model_type, model_name, model`` of every model."""
    return predictions.select("model_type", "model_name").distinct().select(
        "model_type", "model_name", F.concat_ws("_", "model_type", "model_name").alias("model")
    )


def model_inventory(predictions: DataFrame) -> DataFrame:
    """Models per type, names sorted."""
    names = F.sort_array(F.collect_set("model_name"))
    return model_list(predictions).groupBy("model_type").agg(
        F.count("*").alias("models"), F.array_join(names, ",").alias("model_names")
    )


def export_totals(predictions: DataFrame) -> DataFrame:
    """Models and records of a run."""
    return predictions.groupBy("model_type", "model_name").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("models"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")
    )


def with_short_names(models: DataFrame) -> DataFrame:
    """Display name: 3 letters of the type's last part and 3 of the model; may collide."""
    kind = F.substring(F.element_at(F.split("model_type", "_"), -1), 1, 3)
    return models.withColumn(
        "short_name", F.concat(kind, F.lit("_"), F.substring("model_name", 1, 3))
    )
