"""Sequence features by counts that add up."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pairwise.constants import MAX_LAG, RESIDUES
from pairwise.functions import sequence
from pairwise.operators.sequences import composition, residue_usage, sequence_features

TEXTS = st.text(st.sampled_from("ACDWYBX-é日"), max_size=40)


def plain(text):
    """Length, shares and lag values by loops."""
    text = text or ""
    z = dict(zip(RESIDUES, sequence.residue_zscores()))
    out = [len(text), *[text.count(aa) / max(len(text), 1) for aa in RESIDUES]]
    for p in range(3):
        for lag in range(1, MAX_LAG + 1):
            pairs = [(a, b) for a, b in zip(text, text[lag:]) if a in z and b in z]
            out.append(sum((z[a][p] - z[b][p]) ** 2 for a, b in pairs) / len(pairs) if pairs else 0.0)
    return out


def close(found, want):
    assert np.allclose(np.array(found, float), np.array(want, float), rtol=1e-9, atol=1e-12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=6))
def test_a_batch_at_once(texts):
    column = pa.array(["pad", *texts], pa.string()).slice(1)
    coded = sequence.coded(column)
    made = sequence.vectors(sequence.letter_counts(coded), sequence.pair_counts(coded), sequence.pair_weights())
    close(made, [plain(t) for t in texts])


@pytest.mark.parametrize("block", [1, 9, 40, 1 << 22])
def test_blocks_give_the_values_of_the_whole(spark, block):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(RESIDUES + "Xé"), n)) for n in (0, 1, 2, 9, 10, 11, 25, 80, 81)] + [None, "AAAA"]
    rows = [(f"P{k % 10}", t) for k, t in enumerate(texts)] + [(None, "ACDEFGHIKLMN")]
    frame = spark.createDataFrame(rows, "accession string, sequence string")
    found = sorted(([r.accession or "", r.sequence_length, *r.sequence_vector] for r in sequence_features(frame, block).collect()), key=repr)
    want = sorted(([a or "", len(t or ""), *plain(t)] for a, t in rows), key=repr)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    close([r[2:] for r in found], [r[2:] for r in want])


def test_a_very_long_sequence_is_many_tasks(spark):
    """100 MB of one protein: 25 blocks, dealt to all tasks; short ones are not shuffled."""
    unit = "ACDEFGHIKLMNPQRSTVWYX"
    n = 100_000_000 // len(unit)
    frame = spark.createDataFrame([("long", unit), ("short", unit)], "accession string, sequence string").selectExpr(
        "accession", f"CASE WHEN accession = 'long' THEN repeat(sequence, {n}) ELSE sequence END AS sequence"
    )
    rows = {r.accession: r for r in sequence_features(frame).collect()}
    assert rows["long"].sequence_length == n * len(unit)
    close(rows["short"].sequence_vector, plain(unit))
    # the unit repeats, so its cyclic pairs are the pairs of the whole, but for the last few
    z = dict(zip(RESIDUES, sequence.residue_zscores()))
    for lag in (1, 10):
        pairs = [(a, unit[(i + lag) % len(unit)]) for i, a in enumerate(unit)]
        pairs = [(a, b) for a, b in pairs if a in z and b in z]
        want = sum((z[a][0] - z[b][0]) ** 2 for a, b in pairs) / len(pairs)
        assert abs(rows["long"].sequence_vector[20 + lag] - want) < 1e-5


def test_short_sequences_are_not_shuffled(spark):
    frame = spark.createDataFrame([("P", "ACD")], "accession string, sequence string")
    plan = sequence_features(frame)._jdf.queryExecution().executedPlan().toString()
    whole = plan[plan.index("Union") :].split("FlatMapGroupsInArrow")[0]
    assert "MapInArrow" in whole and "Exchange" not in whole


def test_letters_of_all_sequences(spark):
    rows = [("P", "AACX"), ("Q", None), ("R", "WAé")]
    frame = spark.createDataFrame(rows, "accession string, sequence string")
    usage = {r.residue: r.occurrences for r in residue_usage(frame).collect()}
    assert (usage["A"], usage["C"], usage["W"], usage["Y"], len(usage)) == (3, 1, 1, 0, 20)
    shares = {r.accession: r for r in composition(frame).collect()}
    assert (shares["P"].AA_A, shares["P"].sequence_length, shares["Q"].sequence_length) == (0.5, 4, 0)
    assert {r.residue: r.occurrences for r in residue_usage(frame.limit(0)).collect()}["A"] == 0
