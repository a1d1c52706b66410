"""Properties that hold for any input; each test draws many inputs and runs one Spark job."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pairwise.constants import RESIDUES, STRATEGIES
from pairwise.operators import agreement, consensus, distributions, pairs, sequences
from pairwise.params import ConsensusParams

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

rows = st.lists(
    st.tuples(
        st.sampled_from("ABCD"),
        st.sampled_from(["P1", "P2", "P3"]),
        st.sampled_from(["C1", "C2"]),
        st.sampled_from([0, 1]),
        st.integers(0, 20).map(lambda i: i / 20),
        st.integers(0, 20).map(lambda i: i / 20),
    ),
    min_size=8,
    max_size=60,
)


def frame(spark, values):
    data = [("T", m, p, c, y, 1 - a, a, b) for m, p, c, y, a, b in values]
    return spark.createDataFrame(
        data,
        """model_type string, model_name string, protein_id string, compound_id string,
           prediction int, probability_0 double, probability_1 double, confidence double""",
    )


@few
@given(st.lists(st.text(alphabet=RESIDUES, min_size=1, max_size=40), min_size=20, max_size=40))
def test_standard_sequences(spark, texts):
    both = [(i, t, t[::-1]) for i, t in enumerate(texts)]
    forward = spark.createDataFrame([(i, a) for i, a, _ in both], "accession int, sequence string")
    backward = spark.createDataFrame([(i, b) for i, _, b in both], "accession int, sequence string")
    one = sequences.sequence_features(forward).orderBy("accession").collect()
    two = sequences.sequence_features(backward).orderBy("accession").collect()
    for a, b in zip(one, two):
        assert sum(a.sequence_vector[1:21]) == pytest.approx(1)
        assert min(a.sequence_vector[21:]) >= 0
        assert a.sequence_vector == pytest.approx(b.sequence_vector)


@few
@given(rows)
def test_strategies(spark, values):
    params = ConsensusParams()
    stats = pairs.pair_stats(frame(spark, values)).cache()
    found = {n: set() for n in STRATEGIES}
    for r in consensus.memberships(stats, params).collect():
        found[r.strategy].add((r.protein_id, r.compound_id))
    assert found["custom_consensus"] == found["high_confidence"] & found["high_probability"]
    enough = {(r.protein_id, r.compound_id) for r in stats.filter("positive_predictions >= 2").collect()}
    assert all(found[n] <= enough for n in STRATEGIES)
    sizes = {r.strategy: r.pairs for r in consensus.strategy_counts(stats, params).collect()}
    assert sizes == {n: len(found[n]) for n in STRATEGIES}
    sweep = consensus.threshold_sweep(stats, params).orderBy("metric", "threshold").collect()
    for a, b in zip(sweep, sweep[1:]):
        assert a.metric != b.metric or a.pairs >= b.pairs
    bins = distributions.histogram(stats).groupBy("metric").agg(F.sum("pairs"))
    assert {r[1] for r in bins.collect()} == {stats.count()}


@few
@given(rows)
def test_jaccard_matrix(spark, values):
    cells = {(r.a, r.b): r for r in agreement.jaccard(frame(spark, values)).collect()}
    sets = {}
    for model, p, c, y, _, _ in values:
        sets.setdefault(model, set()).update({(p, c)} if y else ())
    models = sorted(sets)
    assert len(cells) == len(models) ** 2
    for (a, b), cell in cells.items():
        x, y = sets[models[a]], sets[models[b]]
        want = 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0
        assert cell.jaccard == pytest.approx(want) and cell.jaccard == cells[b, a].jaccard


def test_results_do_not_depend_on_the_row_order(spark):
    generator = random.Random(5)
    values = [
        (generator.choice("ABCDEFG"), f"P{generator.randrange(9)}", f"C{generator.randrange(9)}",
         generator.randrange(2), generator.randrange(51) / 50, generator.randrange(51) / 50)
        for _ in range(900)
    ]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(values)
        stats = pairs.pair_stats(frame(spark, values).repartition(seed + 2))
        top = consensus.top_by_strategy(stats, ConsensusParams(), 5).select("strategy", "rank", *pairs.PAIR)
        results.append(sorted(tuple(r) for r in top.collect()))
    assert results[0] == results[1] == results[2]
