"""Profile features: 80 column statistics and 140 lag values per protein.

Input rows are ``accession, pos, scores`` with ``pos`` dense from 1 and 20 scores per row.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwise.constants import MAX_LAG, PROFILE_LAG_DIM

COLUMNS = 20
BLOCK = 512  # positions per window group; a longer profile is spread over several tasks


def _per_column(template: str) -> Column:
    """An array with the SQL ``template`` for each of the 20 columns, ``{i}`` being the column."""
    return F.expr(f"array({', '.join(template.format(i=i) for i in range(COLUMNS))})")


def profile_stats(rows: DataFrame) -> DataFrame:
    """``profile_stats``: 20 means, then 20 population deviations, maxima and minima."""
    statistics = ["avg", "stddev_pop", "max", "min"]
    return rows.groupBy("accession").agg(
        F.count("*").alias("positions"),
        F.concat(*[_per_column(name + "(scores[{i}])") for name in statistics]).alias(
            "profile_stats"
        ),
    )


def profile_lag_means(rows: DataFrame) -> DataFrame:
    """``accession, lag, means``: mean squared score difference per column at lags 1..10.

    Positions are cut into blocks and each block also gets the first 10 rows of the next one, so
    every pair at a lag meets in exactly one block and no window group grows with the profile.
    """
    own = F.floor((F.col("pos") - 1) / BLOCK)
    spill = (F.pmod(F.col("pos") - 1, F.lit(BLOCK)) < MAX_LAG) & (own > 0)
    blocks = F.when(spill, F.array(own, own - 1)).otherwise(F.array(own))
    placed = rows.select(
        "accession", "pos", "scores", own.alias("_own"), F.explode(blocks).alias("_block")
    )
    ahead = Window.partitionBy("accession", "_block").orderBy("pos")
    pairs = placed.select(
        "accession",
        "scores",
        (F.col("_own") == F.col("_block")).alias("_inside"),
        F.array(
            *[
                F.struct(F.lit(lag).alias("lag"), F.lead("scores", lag).over(ahead).alias("other"))
                for lag in range(1, MAX_LAG + 1)
            ]
        ).alias("_lags"),
    ).filter("_inside")
    long = pairs.select("accession", "scores", F.inline("_lags")).filter("other IS NOT NULL")
    step = "(scores[{i}] - other[{i}])"
    return long.groupBy("accession", "lag").agg(
        _per_column(f"avg({step} * {step})").alias("means")
    )


def _with_lags(lengths: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``profile_lags`` to a frame of ``accession, positions``.

    With L positions there are min(10, L - 1) lags and each gives the first
    min(20, 140 div lags) columns; the rest of the 140 values is zero.
    """
    # at most ten entries per protein
    lags = profile_lag_means(rows).groupBy("accession").agg(
        F.sort_array(F.collect_list(F.struct("lag", "means"))).alias("_lags")
    )
    n_lags = F.least(F.col("positions") - 1, F.lit(MAX_LAG)).cast("int")
    width = F.least(
        F.lit(COLUMNS), F.floor(F.lit(PROFILE_LAG_DIM) / F.greatest(n_lags, F.lit(1))).cast("int")
    )
    values = F.flatten(
        F.transform(
            F.coalesce("_lags", F.array().cast("array<struct<lag:int,means:array<double>>>")),
            lambda entry: F.slice(entry["means"], F.lit(1), width),
        )
    )
    padded = F.concat(values, F.array_repeat(F.lit(0.0), PROFILE_LAG_DIM - F.size(values)))
    joined = lengths.join(lags, "accession", "left")
    return joined.withColumn("profile_lags", padded).drop("_lags")


def profile_lags(rows: DataFrame) -> DataFrame:
    """``accession, positions, profile_lags`` with 140 values."""
    return _with_lags(rows.groupBy("accession").agg(F.count("*").alias("positions")), rows)


def profile_features(rows: DataFrame) -> DataFrame:
    """``accession, profile_vector`` with 220 values."""
    return _with_lags(profile_stats(rows), rows).select(
        "accession", F.concat("profile_stats", "profile_lags").alias("profile_vector")
    )
