"""Free grids of thresholds against plain counts."""

import random

from pyspark.sql import functions as F

from pairwise.operators import consensus, sweeps
from pairwise.params import ConsensusParams, sweep_thresholds

SCHEMA = "protein_id string, avg_probability_1 double, avg_confidence double, positive_predictions long"


def pairs(n, seed):
    rng = random.Random(seed)
    grid = [k / 20 for k in range(21)] + [float("nan"), rng.random(), 0.7000000000000002]
    return [(f"P{k}", rng.choice(grid), rng.choice(grid), rng.randrange(5)) for k in range(n)]


def test_each_combination_is_counted(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "CELLS", 5)
    rows = pairs(400, 3) + [("same", 0.5, 0.5, 2)] * 50
    probabilities, confidences, levels = [0.7, 0.5, 0.55, 0.5, 1.0], [0.0, 0.3, 0.95], [0, 2, 9]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {(r.probability, r.confidence, r.positives): r.pairs for r in sweeps.threshold_grid(frame, probabilities, confidences, levels).collect()}
    want = {
        (p, c, k): sum(a >= p and b >= c and n >= k for _, a, b, n in rows)
        for p in probabilities for c in confidences for k in levels
    }
    assert found == want


def test_the_sweep_and_the_counts_are_lines_of_the_grid(spark):
    frame = spark.createDataFrame(pairs(300, 5), SCHEMA)
    params = ConsensusParams()
    grid = sweeps.threshold_grid(frame, sweep_thresholds(), [0.0], [2]).collect()
    sweep = {r.threshold: r.pairs for r in consensus.threshold_sweep(frame, params).collect() if r.metric == "probability"}
    sure = spark.createDataFrame([r for r in frame.collect() if r.avg_confidence == r.avg_confidence], SCHEMA)
    sweep_sure = {r.threshold: r.pairs for r in consensus.threshold_sweep(sure, params).collect() if r.metric == "probability"}
    assert {r.probability: r.pairs for r in grid} == sweep_sure and sweep.keys() == sweep_sure.keys()
    both = sweeps.threshold_grid(frame, [params.probability], [params.confidence]).first().pairs
    assert both == consensus.threshold_counts(frame, params).first().over_both


def test_a_million_combinations(spark):
    """1,000 x 1,000 thresholds: the plan is that of two thresholds."""
    steps = [k / 1000 for k in range(1000)]
    frame = spark.range(20_000).select(
        ((F.col("id") % 1000) / 1000).alias("avg_probability_1"), ((F.col("id") % 777) / 777).alias("avg_confidence"),
        F.lit(3).cast("long").alias("positive_predictions"),
    )

    def size(grid):
        return len(grid._jdf.queryExecution().executedPlan().toString())

    whole = sweeps.threshold_grid(frame, steps, steps)
    assert size(whole) < 1.2 * size(sweeps.threshold_grid(frame, steps[:2], steps[:2]))
    found = whole.agg(F.count("*").alias("cells"), F.max("pairs").alias("most"), F.sum("pairs").alias("total")).first()
    want = sum((k % 1000 + 1) * (int((k % 777) / 777 * 1000 + 1e-9) + 1) for k in range(20_000))
    assert found.cells == 1_000_000 and found.most == 20_000 and abs(found.total - want) < 1e-6 * want


def test_no_pairs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [r.pairs for r in sweeps.threshold_grid(empty, [0.5, 0.6], [0.5]).collect()] == [0, 0]
