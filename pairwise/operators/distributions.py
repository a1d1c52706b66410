"""Distribution of probability, confidence and positive ratio over the pairs."""

from pyspark.sql import Column, DataFrame, functions as F

from pairwise.functions.quantiles import exact_quantiles
from pairwise.functions.scalar import MEAN_DIGITS, count_where, percent
from pairwise.operators.pairs import PAIR

METRICS = {
    "probability": "avg_probability_1",
    "confidence": "avg_confidence",
    "ratio": "positive_ratio",
}


def metric_values(stats: DataFrame) -> DataFrame:
    """``metric, value``: the three metrics of every pair, in place.

    All figures below are aggregates over this frame that combine before the shuffle, so no exchange
    carries a row per pair. Most read it more than once: stage the statistics first.
    """
    entries = [
        F.struct(F.lit(m).alias("metric"), F.round(column, MEAN_DIGITS).alias("value"))
        for m, column in METRICS.items()
    ]
    return stats.select(F.inline(F.array(*entries)))


def distribution_stats(stats: DataFrame) -> DataFrame:
    """Mean, median, population deviation, minimum and maximum per metric.

    One NaN makes every figure of its metric NaN.
    """
    values, v = metric_values(stats), F.col("value")
    plain = values.groupBy("metric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    medians = exact_quantiles(values.filter(~F.isnan(v)), [0.5])
    tainted = F.isnan("max")
    figures = ["mean", "median", "std", "min", "max"]
    # one row per metric
    return plain.join(F.broadcast(medians.withColumnRenamed("quantile", "median")), "metric", "left").select(
        "metric",
        *[F.when(tainted, F.lit(float("nan"))).otherwise(F.col(f)).alias(f) for f in figures],
    )


def _shares(stats: DataFrame, groups: list[tuple[str, Column]], label: str) -> DataFrame:
    """Count and percentage per labelled condition, zero counts included; one pass."""
    names = [f"_c{i}" for i in range(len(groups))]
    row = stats.agg(
        F.count("*").alias("_total"), *[count_where(c).alias(n) for n, (_, c) in zip(names, groups)]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(text).alias(label),
            F.col(name).alias("pairs"),
            percent(F.col(name), F.col("_total")).alias("percent"),
        )
        for i, (name, (text, _)) in enumerate(zip(names, groups), start=1)
    ]
    return row.select(F.inline(F.array(*entries)))


def ratio_groups(stats: DataFrame) -> DataFrame:
    """Six groups of the positive ratio, closed on the right."""
    r = F.col("positive_ratio")
    groups = [
        ("0", r == 0),
        ("(0,0.25]", (r > 0) & (r <= 0.25)),
        ("(0.25,0.5]", (r > 0.25) & (r <= 0.5)),
        ("(0.5,0.75]", (r > 0.5) & (r <= 0.75)),
        ("(0.75,1)", (r > 0.75) & (r < 1)),
        ("1", r == 1),
    ]
    return _shares(stats, groups, "ratio_group")


def ratio_bins(stats: DataFrame) -> DataFrame:
    """Four quarters of the positive ratio, closed on the left; the last one includes 1."""
    r = F.col("positive_ratio")
    groups = [
        ("0-25%", (r >= 0) & (r < 0.25)),
        ("25-50%", (r >= 0.25) & (r < 0.5)),
        ("50-75%", (r >= 0.5) & (r < 0.75)),
        ("75-100%", (r >= 0.75) & (r <= 1)),
    ]
    return _shares(stats, groups, "ratio_bin")


def histogram(stats: DataFrame, bins: int = 20, metrics=tuple(METRICS)) -> DataFrame:
    """Equal bins between minimum and maximum, all half-open but the last; empty bins included.

    A value's bin is the number of inner edges that do not exceed it. Division finds it but for rounding, so
    the two edges next to it are compared, which is safe for values on an edge. A metric with a single value
    gets the range value ± 0.5.
    """
    values = metric_values(stats).filter(F.col("metric").isin(*metrics) & ~F.isnan("value"))
    lo, hi = F.min("value"), F.max("value")
    spans = values.groupBy("metric").agg(
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
        F.count("*").alias("total"),
    )
    spans = spans.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    value, first, width = F.col("value"), F.col("lo"), F.col("width")
    guess = F.greatest(F.least(F.floor((value - first) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    below = (F.col("guess") > 0) & (value < first + width * F.col("guess"))
    above = (F.col("guess") < bins - 1) & (value >= first + width * (F.col("guess") + 1))
    bin_ = F.col("guess") - below.cast("int") + above.cast("int")
    # spans: one row per metric
    filled = (
        values.join(F.broadcast(spans), "metric")
        .withColumn("guess", guess)
        .groupBy("metric", bin_.alias("bin"))
        .agg(F.count("*").alias("pairs"))
    )
    frame = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    start = F.col("lo") + F.col("width") * F.col("bin")
    end = F.col("lo") + F.col("width") * (F.col("bin") + 1)
    pairs = F.coalesce("pairs", F.lit(0))
    return frame.join(filled, ["metric", "bin"], "left").select(
        "metric",
        "bin",
        start.alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(end).alias("bin_end"),
        pairs.alias("pairs"),
        (pairs / (F.col("total") * F.col("width"))).alias("density"),
    )


def density(stats: DataFrame, bins: int = 30) -> DataFrame:
    """Density histogram of probability and confidence."""
    return histogram(stats, bins, ("probability", "confidence")).drop("pairs")


def box_stats(stats: DataFrame) -> DataFrame:
    """Box-plot figures: quartiles, whiskers at the last value within 1.5 IQR, outlier count."""
    values, v = metric_values(stats).filter(~F.isnan("value")), F.col("value")
    at = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    fences = (
        exact_quantiles(values, list(at))
        .groupBy("metric")
        .agg(
            *[
                F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
                for p, name in at.items()
            ]
        )
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = fences.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    beyond = (v < F.col("low")) | (v > F.col("high"))
    # fences: one row per metric
    boxes = values.join(F.broadcast(fences), "metric").groupBy("metric", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("low"), v)).alias("low_end"),
        F.max(F.when(v <= F.col("high"), v)).alias("high_end"),
        F.count_if(beyond).alias("outliers"),
    )
    return boxes.select(
        "metric",
        "q1",
        "median",
        "q3",
        F.least("low_end", "q1").alias("whisker_low"),
        F.greatest("high_end", "q3").alias("whisker_high"),
        "outliers",
    )


def scatter(stats: DataFrame) -> DataFrame:
    """Mean probability against mean confidence, coloured by ratio."""
    return stats.select(*PAIR, "avg_probability_1", "avg_confidence", "positive_ratio")
