"""Hand-sized frames with values worked out by hand."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwise.constants import DESCRIPTORS
from pairwise.functions import quantiles
from pairwise.functions.quantiles import exact_quantiles
from pairwise.functions.scalar import finite_or_zero, number, rounded_to, strip
from pairwise.functions.sequence import residue_table, residue_zscores
from pairwise.operators import (
    agreement,
    assemble,
    compounds,
    consensus,
    distributions,
    entities,
    ordinal,
    pairs,
    profiles,
    sequences,
)
from pairwise.params import ConsensusParams, sweep_thresholds
from pairwise.sinks import tables

P = ConsensusParams()
NAN = float("nan")

PREDICTIONS = [
    ("T", "A", "P1", "C1", 1, 0.1, 0.9, 0.9),
    ("T", "B", "P1", "C1", 1, 0.3, 0.7, 0.7),
    ("T", "A", "P1", "C2", 1, 0.4, 0.6, 0.6),
    ("T", "B", "P1", "C2", 1, 0.5, 0.5, 0.5),
    ("T", "A", "P2", "C1", 1, 0.1, 0.9, 0.9),
    ("T", "B", "P2", "C1", 1, 0.2, 0.8, 0.8),
    ("T", "C", "P2", "C1", 0, 0.6, 0.4, 0.6),
    ("T", "A", "P2", "C2", 1, 0.01, 0.99, 0.99),
    ("T", "A", "P3", "C1", 0, 0.8, 0.2, 0.8),
    ("T", "B", "P3", "C1", 0, 0.9, 0.1, 0.9),
]
SCHEMA = """model_type string, model_name string, protein_id string, compound_id string,
            prediction int, probability_0 double, probability_1 double, confidence double"""


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(PREDICTIONS, SCHEMA).cache()


@pytest.fixture(scope="module")
def stats(predictions):
    return pairs.pair_stats(predictions).cache()


def test_rounding_is_that_of_spark_to_the_bit(spark):
    odd = [None, NAN, math.inf, -math.inf, 0.0, -0.0, -1e-9, 5e-7, 2.5e-6, 1.0000005, -0.0000015, 1e300, 8796093.0222085, 1 / 3]
    values = spark.createDataFrame([(v,) for v in odd], "v double").unionAll(
        spark.range(200_000).select(((F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 12)).alias("v"))
    ).unionAll(spark.range(20_000).select((F.col("id") / 2e6).alias("v")))  # half of them ties
    for digits in (0, 6, 12):
        got, want = F.hex(rounded_to(F.col("v"), digits).cast("string")), F.hex(F.round("v", digits).cast("string"))
        assert values.filter(~got.eqNullSafe(want)).count() == 0


def test_pair_stats(stats):
    rows = {(r.protein_id, r.compound_id): r for r in stats.collect()}
    assert len(rows) == 5
    row = rows["P2", "C1"]
    assert (row.total_models, row.positive_predictions, row.negative_predictions) == (3, 2, 1)
    assert row.positive_ratio == pytest.approx(2 / 3)
    assert row.avg_probability_1 == pytest.approx(0.7)
    assert row.avg_confidence == pytest.approx(0.7666667)


def test_membership(stats):
    found = {}
    for r in consensus.memberships(stats, P).collect():
        found.setdefault((r.protein_id, r.compound_id), set()).add(r.strategy)
    everything = set(consensus.scores())
    assert found == {
        ("P1", "C1"): everything,
        ("P1", "C2"): {"all_positive", "majority_positive"},
        ("P2", "C1"): everything - {"all_positive"},
    }


def test_strategy_order(stats):
    ordered = consensus.select_strategy(stats, "majority_positive", P).collect()
    assert [(r.protein_id, r.compound_id) for r in ordered] == [("P1", "C1"), ("P2", "C1"), ("P1", "C2")]


def test_mean_on_the_threshold_counts_whatever_the_order(spark):
    values = [0.58, 0.74, 0.78, 0.7]  # mean 0.7, reached with rounding noise in some orders
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        rows = [("T", str(i), "P", "C", 1, 0.0, values[i], values[i]) for i in order]
        one = pairs.pair_stats(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        assert consensus.matching(one, "high_confidence", P).count() == 1


def test_nan_never_passes_a_threshold_and_sorts_last(spark):
    rows = [("T", m, "P", c, 1, 0.0, v, v) for m in "AB" for c, v in (("C1", NAN), ("C2", 0.9))]
    odd = pairs.pair_stats(spark.createDataFrame(rows, SCHEMA))
    assert {r.compound_id for r in consensus.matching(odd, "custom_consensus", P).collect()} == {"C2"}
    everyone = consensus.select_strategy(odd, "all_positive", P).collect()
    assert [r.compound_id for r in everyone] == ["C2", "C1"]
    spread = {r.metric: r for r in distributions.distribution_stats(odd).collect()}
    assert all(math.isnan(spread["probability"][f]) for f in ("mean", "median", "std", "min", "max"))
    assert spread["ratio"]["median"] == 1.0


def test_legacy_key_is_cut_at_the_first_underscore(spark):
    rows = [("T", "A", "P_1", "C", 1, 0, 1.0, 1.0), ("T", "A", "P", "1_C", 1, 0, 1.0, 1.0)]
    frame = spark.createDataFrame([tuple(map(lambda v: float(v) if v == 0 else v, r)) for r in rows], SCHEMA)
    assert pairs.pair_stats(frame).count() == 2
    (row,) = pairs.pair_stats(frame, legacy_key=True).collect()
    assert (row.protein_id, row.compound_id, row.total_models) == ("P", "1_C", 2)


def test_funnel_uses_a_fixed_two(stats):
    counts = {r.name: r.pairs for r in consensus.funnel(stats, ConsensusParams(min_consensus=3)).collect()}
    assert counts["total"] == 5 and counts["one_positive"] == 4 and counts["two_positives"] == 3
    assert counts["custom_consensus"] == 0


def test_advice_names_only_what_applies(stats):
    assert [r.code for r in consensus.advice(stats, P).collect()] == ["validate_all_positive_first"]


def test_ratio_edges(spark):
    stats = spark.createDataFrame([(r,) for r in (0.0, 0.25, 0.5, 0.75, 1.0)], "positive_ratio double")
    assert [r.pairs for r in distributions.ratio_groups(stats).orderBy("position").collect()] == [1, 1, 1, 1, 0, 1]
    assert [r.pairs for r in distributions.ratio_bins(stats).orderBy("position").collect()] == [1, 1, 1, 2]


def _metric_frame(spark, values):
    rows = [(float(v), float(v), float(v)) for v in values]
    columns = "avg_probability_1 double, avg_confidence double, positive_ratio double"
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("values", [[0.1 * i for i in range(11)], [0.5, 0.5], [0, 1, 1, 1, 0.3, 0.35]])
def test_histogram_agrees_with_numpy(spark, values):
    values = [round(v, 12) for v in values]
    rows = distributions.histogram(_metric_frame(spark, values), 20, ("ratio",)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r.pairs for r in rows] == list(counts)
    assert [r.bin_start for r in rows] == pytest.approx(list(edges[:-1]))
    density, _ = np.histogram(values, bins=20, density=True)
    assert [r.density for r in rows] == pytest.approx(list(density))


def test_box_stats(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 9, 50]
    (row,) = distributions.box_stats(_metric_frame(spark, values)).filter("metric = 'ratio'").collect()
    assert (row.q1, row.median, row.q3) == pytest.approx((3.25, 5.5, 7.75))
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1, 9, 1)


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    hot = [0.25] * (n // 3)  # one value holds a good part of the rows
    values = [*hot, *rng.lognormal(0, 3, n).tolist()]
    frame = spark.createDataFrame([("k", float(v)) for v in values], "metric string, value double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    rows = exact_quantiles(frame, probabilities).orderBy("probability").collect()
    assert [r["quantile"] for r in rows] == pytest.approx(np.quantile(values, probabilities).tolist())


def test_exact_quantiles_of_values_that_crowd_together(spark):
    """A million distinct values, all but one within 1e-6 of each other."""
    n = 1_000_000
    value = F.when(F.col("id") == 0, 1.0).otherwise(F.lit(0.25) + F.col("id") * 7 % n * 1e-12)
    frame = spark.range(n).select(F.lit("k").alias("metric"), value.alias("value"))
    exact = np.append(0.25 + np.arange(1, n) * 7 % n * 1e-12, 1.0)
    rows = exact_quantiles(frame, [0.25, 0.5, 0.999]).orderBy("probability").collect()
    assert [r["quantile"] for r in rows] == pytest.approx(np.quantile(exact, [0.25, 0.5, 0.999]), abs=1e-15)


def _counted_passes(monkeypatch):
    passes = []
    for name in ("_sketched", "_fetched"):
        own = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, own=own, name=name: passes.append(name) or own(*a))
    return passes


@pytest.mark.parametrize("small,most", [(quantiles.SMALL, 2), (500, 3)])
def test_quantiles_take_a_fixed_number_of_passes(spark, monkeypatch, small, most):
    passes = _counted_passes(monkeypatch)
    n = 400_000
    crowd = F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.pow(F.col("id") * 7919 % n + 1.0, -4.0))
    frame = spark.range(n).select(F.lit("k").alias("metric"), crowd.alias("value"))
    ids = np.arange(n)
    exact = np.where(ids % 3 == 0, 0.25, (ids * 7919 % n + 1.0) ** -4.0)
    at = [0.0, 0.25, 0.5, 0.9, 0.99999, 1.0]
    rows = exact_quantiles(frame, at, small).orderBy("probability").collect()
    assert [r["quantile"] for r in rows] == pytest.approx(np.quantile(exact, at).tolist(), rel=1e-12)
    assert len(passes) <= most


def test_a_wrong_sketch_costs_passes_and_not_results(spark, monkeypatch):
    own, wrong = quantiles._bracket, iter([(0.9, 0.95, 1), (0.05, 0.1, 1), (0.2, 0.21, 1e9)])
    monkeypatch.setattr(quantiles, "_bracket", lambda *a: next(wrong, None) or own(*a))
    frame = spark.range(1000).select(F.lit("k").alias("metric"), (F.col("id") / 1000).alias("value"))
    (row,) = exact_quantiles(frame, [0.5]).collect()
    assert row["quantile"] == pytest.approx(0.4995)


def test_quantiles_of_nothing_and_of_infinite_values(spark):
    empty = spark.createDataFrame([], "metric string, value double")
    assert exact_quantiles(empty, [0.5]).count() == 0
    inf = float("inf")
    frame = spark.createDataFrame([("k", v) for v in (-inf, -inf, 0.0, inf, inf)], "metric string, value double")
    rows = exact_quantiles(frame, [0.25, 0.5, 0.75]).orderBy("probability").collect()
    assert [r["quantile"] for r in rows] == [-inf, 0.0, inf]


def test_means_agree_with_exact_fractions(spark):
    """Rounded means meet thresholds as the exact ones do, for values of few decimals."""
    rng = np.random.default_rng(4)
    cells = [(f"P{k}", int(v)) for k in range(300) for v in rng.integers(0, 51, rng.integers(1, 15))]
    rows = [("T", str(i), p, "C", 1, 0.0, v / 50, v / 50) for i, (p, v) in enumerate(cells)]
    found = {r.protein_id: r for r in pairs.pair_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for p in found:
        own = [v for q, v in cells if q == p]
        mean = Fraction(sum(own), 50 * len(own))
        assert found[p].avg_confidence == pytest.approx(float(mean), abs=1e-12)
        for threshold in (Fraction(6, 10), Fraction(7, 10)):
            assert (found[p].avg_confidence >= float(threshold)) == (mean >= threshold)


def test_missing_cells_break_no_rule(spark):
    row = {"MW": NAN, "LogP": NAN, "HBA": 1.0, "HBD": 1.0, "RotBonds": 2.0, "AtomCount": 30.0, "TPSA": NAN}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    flags = frame.select(*[c.alias(n) for n, c in compounds.rule_flags().items()]).first()
    assert tuple(flags) == (0, 1, 0)


def test_descriptors_of_one_compound_that_differ(spark):
    rows = [("CC", 2.0, NAN), ("CC", 1.0, 9.0), ("CC", 1.0, 3.0), ("O", 4.0, 4.0)]
    frame = spark.createDataFrame(rows, "smile string, MW double, LogP double")
    for n in (1, 3):
        assert sorted(map(tuple, compounds.one_per_key(frame.repartition(n), "smile").collect())) == [("CC", 1.0, 3.0), ("O", 4.0, 4.0)]


def test_no_suggestion_without_positives(spark):
    rows = [("T", m, "P", "C", 0, 1.0, 0.0, 1.0) for m in "AB"]
    matrix = agreement.jaccard(spark.createDataFrame(rows, SCHEMA))
    assert agreement.complementarity(matrix).count() == 0


def test_more_than_ten_models_may_be_asked_for():
    assert ConsensusParams(min_consensus=12).min_consensus == 12


def _positives(spark, sets):
    rows = [("T", m, x, "c", 1, 0.0, 1.0, 1.0) for m, xs in sets.items() for x in xs]
    rows += [("T", m, "none", "c", 0, 0.0, 1.0, 1.0) for m in sets]
    return spark.createDataFrame(rows, SCHEMA)


def test_jaccard(spark):
    frame = _positives(spark, {"A": "xyz", "B": "yzw", "C": ""})
    matrix = agreement.jaccard(frame).cache()
    cells = {(r.model_a[-1], r.model_b[-1]): r for r in matrix.collect()}
    assert len(cells) == 9
    assert cells["A", "B"].jaccard == 0.5 and cells["A", "C"].jaccard == 0
    assert cells["C", "C"].jaccard == 1
    assert cells["A", "B"].coverage_a == pytest.approx(2 / 3) == cells["A", "B"].coverage_b
    (summary,) = agreement.jaccard_summary(matrix).collect()
    assert summary.mean_jaccard == pytest.approx(1 / 6)
    extremes = {r.kind: (r.model_a[-1], r.model_b[-1]) for r in agreement.jaccard_extremes(matrix).collect()}
    assert extremes == {"most": ("A", "B"), "least": ("A", "C")}
    verdicts = {r.model[-1]: r.verdict for r in agreement.complementarity(matrix).collect()}
    assert verdicts["A"] == "keep"


def test_jaccard_without_positives_has_no_summary(spark):
    matrix = agreement.jaccard(_positives(spark, {"A": "", "B": ""}))
    assert agreement.jaccard_summary(matrix).count() == 0
    assert agreement.jaccard_extremes(matrix).count() == 0


def test_jaccard_of_more_models_than_one_mask_word_holds(spark):
    sets = {f"m{i:03d}": [f"p{j}" for j in range(i % 7, 20)] for i in range(70)}
    cells = {(r.model_a, r.model_b): r.jaccard for r in agreement.jaccard(_positives(spark, sets)).collect()}
    assert len(cells) == 70 * 70
    for a, b in (("m000", "m069"), ("m061", "m062"), ("m013", "m068")):
        x, y = set(sets[a]), set(sets[b])
        assert cells[f"T_{a}", f"T_{b}"] == pytest.approx(len(x & y) / len(x | y))


def test_fractional_predictions(spark):
    rows = [("T", "A", f"P{i}", "C", v, 0.0, 0.5, 0.5) for i, v in enumerate((1.9, 1.0, 0.9, NAN))]
    frame = spark.createDataFrame(rows, SCHEMA.replace("prediction int", "prediction double"))
    assert {r.protein_id for r in agreement.positives(frame).collect()} == {"P0", "P1"}
    assert pairs.pair_stats(frame).agg(F.sum("positive_predictions")).first()[0] == 1


def test_short_names(spark):
    models = spark.createDataFrame([("deep_forest", "alpha"), ("svm", "be")], "model_type string, model_name string")
    assert {r.short_name for r in pairs.with_short_names(models).collect()} == {"for_alp", "svm_be"}


def test_parameters_are_checked():
    for bad in ({"probability": 1.1}, {"confidence": -0.1}, {"min_consensus": 0}):
        with pytest.raises(ValueError):
            ConsensusParams(**bad)
    assert ConsensusParams.preset("strict").probability == 0.8
    assert sweep_thresholds() == [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


# ---- features ----------------------------------------------------------------------------------


def test_residue_zscores(spark):
    z = residue_zscores()
    assert z.mean(axis=0) == pytest.approx([0, 0, 0]) and z.std(axis=0) == pytest.approx([1, 1, 1])
    row = residue_table(spark).filter("residue = 'A'").first()
    assert row.hydrophobicity == pytest.approx((1.8 + 0.49) / 2.911339897710331)
    assert row.molecular_weight == pytest.approx((89.1 - 136.89) / 30.08323287148507)


def _vectors(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "accession int, sequence string")
    found = sequences.sequence_features(frame).orderBy("accession").collect()
    return [r.sequence_vector for r in found]


def test_sequence_vector(spark):
    first, second, single, empty, none = _vectors(spark, ["ACDX", "MKV", "A", "", None])
    assert len(first) == 51
    assert first[0] == 4 and first[1:4] == [0.25] * 3 and sum(first[1:21]) == 0.75
    lags = [first[21:24], first[31:34], first[41:44]]
    assert lags[0] == pytest.approx([2.152574, 3.314102, 0], abs=1e-6)
    assert lags[1] == pytest.approx([0.977720, 3.371449, 0], abs=1e-6)
    assert lags[2] == pytest.approx([0.643104, 2.139224, 0], abs=1e-6)
    assert second[21:24] == pytest.approx([5.854835, 0.624123, 0], abs=1e-6)
    assert single[:2] == [1, 1] and not any(single[21:])
    assert not any(empty) and not any(none)


def test_sequence_with_letters_outside_latin(spark):
    (vector,) = _vectors(spark, ["Aß中🧬C"])
    assert vector[0] == 5 and vector[1] == vector[2] == 0.2


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 9, 10, 11, 25, 1100])
def test_profile_vector(spark, length):
    """Blocks of 512 positions: the long profile crosses two block edges."""
    matrix = np.random.default_rng(length).integers(-9, 9, (length, 20)).astype(float)
    rows = [("P", i + 1, row.tolist()) for i, row in enumerate(matrix)]
    frame = spark.createDataFrame(rows, "accession string, pos int, scores array<double>")
    (found,) = profiles.profile_features(frame).collect()
    lags = min(10, length - 1)
    width = min(20, 140 // max(lags, 1))
    tail = [
        v
        for lag in range(1, lags + 1)
        for v in ((matrix[:-lag] - matrix[lag:]) ** 2).mean(axis=0)[:width]
    ]
    want = np.concatenate([matrix.mean(0), matrix.std(0), matrix.max(0), matrix.min(0), tail])
    want = np.pad(want, (0, 220 - len(want)))
    assert found.profile_vector == pytest.approx(want.tolist())


def test_rule_flags(spark):
    columns = ["MW", "LogP", "HBA", "HBD", "RotBonds", "AtomCount", "TPSA"]
    rows = [(300.0, 2.0, 5, 2, 5, 30, 60.0), (600.0, 2.0, 5, 2, 5, 30, 60.0), (300.0, 2.0, 5, 2, 11, 30, 60.0),
            (300.0, 2.0, 5, 2, 5, 30, 141.0)]
    frame = spark.createDataFrame(rows, columns)
    flags = [tuple(r) for r in frame.select(list(compounds.rule_flags().values())).collect()]
    assert flags == [(0, 0, 0), (1, 1, 0), (0, 1, 1), (0, 0, 1)]


def test_element_census(spark):
    texts = {
        "CCC(CCC(C)O)COP(=O)(OC1=CC=CC=C1)OC2=CC=CC=C2": {
            "CarbonCount": 20, "OxygenCount": 5, "PhosphorusCount": 1, "HeavyAtomCount": 26, "NO_Count": 5,
        },
        r"F/C=C\Cl": {"FluorineCount": 1, "CarbonCount": 2, "ChlorineCount": 1, "HalogenCount": 2},
        "[nH]1cccc1": {"NitrogenCount": 1, "CarbonCount": 4, "HeavyAtomCount": 5},
        "[Na+].[Cl-]": {"ChlorineCount": 1, "HeavyAtomCount": 2},
        "[13C@@H](Br)I": {"CarbonCount": 1, "BromineCount": 1, "IodineCount": 1},
        "[H]O[H]": {"OxygenCount": 1, "AtomCount": 1},
        "c1[se]ccc1": {"CarbonCount": 4, "SulfurCount": 0, "HeavyAtomCount": 5},
        "*C[*]": {"CarbonCount": 1, "AtomCount": 3, "HeavyAtomCount": 1},
        "": {"AtomCount": 0},
    }
    frame = spark.createDataFrame([(t, t) for t in texts], "id string, text string")
    for row in compounds.element_census(frame, "id", "text").collect():
        for name, value in texts[row.id].items():
            assert row[name] == value, (row.id, name)


def test_descriptor_alignment(spark):
    frame = spark.createDataFrame([(NAN, float("inf"), True, None, 7.0)], "MW double, LogP double, RO5_Violations boolean, HBA int, RotBonds double")
    full = compounds.complete_descriptors(frame)
    (row,) = full.select(compounds.aligned(full)).collect()
    assert row.asDict().keys() == set(DESCRIPTORS)
    assert (row.MW, row.LogP, row.HBA, row.RO5_Violations) == (0.0, 0.0, 0.0, 1.0)
    assert row.LipinskiViolations == row.RotBonds == 7.0 and row.TPSA == 0.0


def test_first_row_wins(spark):
    rows = spark.createDataFrame(
        [(3, "P", "LATE", "C"), (1, "P", "FIRST", "C"), (2, "Q", "ONLY", "C")],
        "row_no long, accession string, sequence string, compound_cid string",
    )
    found = {r.accession: (r.sequence, r.first_row) for r in entities.unique_proteins(rows).collect()}
    assert found == {"P": ("FIRST", 1), "Q": ("ONLY", 2)}
    flags = {r.row_no: (r.protein_is_unique, r.compound_is_unique) for r in entities.with_uniqueness_flags(rows).collect()}
    assert flags == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_missing_features_become_zero(spark):
    rows = spark.createDataFrame([(1, "P", "ACD", "C", "s", "")], "row_no long, accession string, sequence string, compound_cid string, smile string, label string")
    proteins = spark.createDataFrame([], "accession string, sequence_length long, pssm_available boolean, sequence_vector array<double>, profile_vector array<double>")
    molecules = spark.createDataFrame([], "compound_cid string, compound_vector array<double>")
    full = assemble.assemble(rows, proteins, molecules)
    combined = full.select(assemble.combined_columns()).first()
    assert len(combined) == 338 and combined["Length"] == 3.0 and sum(combined[2:272]) == 0
    assert len(full.select(assemble.detailed_columns()).columns) == 342
    flagged = assemble.assemble(rows, proteins, molecules, flagged=True)
    assert len(flagged.select(assemble.flagged_columns()).columns) == 344
    assert flagged.first().protein_is_unique and flagged.first().compound_is_unique
    assert full.first().pssm_available is False and full.first().sequence_length == 3


def test_positions_and_order_check(spark):
    frame = spark.range(1, 251).select(F.col("id").alias("row_no")).repartition(7)
    placed = ordinal.with_positions(frame, "row_no", "position", chunk=40).collect()
    assert all(r.position == r.row_no for r in placed) and len(placed) == 250
    assert tables.order_is_intact(frame)
    broken = frame.filter("row_no <> 17")
    assert not tables.order_is_intact(broken)
    marked = broken.withColumn("accession", F.lit("")).withColumn("compound_cid", F.lit(""))
    verdicts = tables.order_verification(marked).collect()
    assert sum(r.Order_OK == "NO" for r in verdicts) == 233
    assert tables.order_is_intact(frame.limit(0))


def test_progress(spark):
    unique = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    store = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    assert tuple(entities.progress(unique, store, "k").first()) == (1, 4, 25.0)
    assert tuple(entities.progress(unique.limit(0), store, "k").first()) == (0, 0, 0.0)


def test_scalars(spark):
    frame = spark.createDataFrame([("　 a b\t\n",), ("NA",), ("True",), (" 1.5 ",), ("x",), (None,)], "t string")
    texts = [r[0] for r in frame.select(strip(F.col("t"))).collect()]
    assert texts == ["a b", "NA", "True", "1.5", "x", None]
    values = [r[0] for r in frame.select(number(F.col("t"))).collect()]
    assert [None if math.isnan(v) else v for v in values] == [None, None, 1.0, 1.5, None, None]
    zeroed = frame.select(finite_or_zero(number(F.col("t")))).collect()
    assert [r[0] for r in zeroed] == [0, 0, 1.0, 1.5, 0, 0]


def test_feature_usage(spark):
    nan = float("nan")
    rows = [([1.0, 0.0, nan], [0.0, 2.0], None), ([0.0, 0.0], [None, 2.0], [3.0]), (None, [], [0.0])]
    frame = spark.createDataFrame(rows, ", ".join(f"{v} array<double>" for v in assemble.VECTORS)).repartition(2)
    found = {(r.block, r.idx): r.nonzero for r in assemble.feature_usage(frame).collect()}
    blocks = [v.removesuffix("_vector") for v in assemble.VECTORS]
    want = {(0, 0): 1, (0, 1): 0, (0, 2): 1, (1, 0): 0, (1, 1): 2, (2, 0): 1}
    assert found == {(blocks[b], i): n for (b, i), n in want.items()}
    assert assemble.feature_usage(frame.limit(0)).count() == 0
