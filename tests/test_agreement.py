"""Model agreement by blocked products."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from pairwise.operators import agreement
from pairwise.operators.agreement import jaccard, numbered_models, overlap_counts

SCHEMA = "model_type string, model_name string, protein_id string, compound_id string, prediction double"


def frame_of(spark, sets):
    rows = [(f"t{m % 3}", f"m{m:04d}", f"P{p}", "C", 1.0) for m, pairs in enumerate(sets) for p in pairs]
    rows += [(f"t{m % 3}", f"m{m:04d}", "none", "C", 0.0) for m in range(len(sets))]
    return spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(4)


@pytest.mark.parametrize(("block", "matrices", "lists"), [(1, 2, 3), (3, 64, 7), (512, 64, 2048)])
def test_counts_do_not_depend_on_the_blocks(spark, monkeypatch, block, matrices, lists):
    for name, value in (("BLOCK", block), ("MATRICES", matrices), ("LISTS", lists)):
        monkeypatch.setattr(agreement, name, value)
    rng = random.Random(1)
    sets = [set(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(8)] + [set()]
    frame = frame_of(spark, sets)
    models = numbered_models(frame)
    order = [int(r.model_name[1:]) for r in models.orderBy("index").collect()]
    found = {(order[r.a], order[r.b]): r.shared for r in overlap_counts(frame, models, len(sets)).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.product(range(9), repeat=2) if sets[a] & sets[b]}
    assert found == want


def test_two_thousand_models(spark):
    """Models are data: the plan does not grow with them, and all four million cells are right in sum."""
    n = 2000
    hits = spark.range(n).select(
        F.lit("t").alias("model_type"), F.format_string("m%05d", "id").alias("model_name"),
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "id",
    )
    # model i calls five pairs positive, i to i + 4: models i and j share max(0, 5 - |i - j|)
    frame = hits.select(
        "model_type", "model_name", F.concat(F.lit("P"), (F.col("id") + F.col("k")).cast("string")).alias("protein_id"),
        F.lit("C").alias("compound_id"), F.lit(1.0).alias("prediction"),
    )
    start = time.perf_counter()
    matrix = jaccard(frame)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - start < 60 and len(plan) < 60_000
    total = matrix.agg(F.count("*").alias("cells"), F.sum("shared").alias("shared"), F.sum(F.expr("abs(shared - greatest(0, 5 - abs(a - b)))")).alias("wrong")).first()
    assert (total.cells, total.wrong) == (n * n, 0)
    assert total.shared == n * 5 + 2 * sum((n - d) * (5 - d) for d in range(1, 5))
