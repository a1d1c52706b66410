"""Element counts from bytes against the token pattern they stand for."""

import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pairwise.functions.smiles import COUNT_NAMES, element_counts, with_census
from pairwise.operators.compounds import element_census

BRACKET = re.compile(r"\[[0-9]*([A-Z][a-z]?|[a-z]+|\*)[^\]]*\]")
TOKEN = re.compile(r"\[[0-9]*(?:[A-Z][a-z]?|[a-z]+|\*)[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]|\*")


def plain(text):
    symbols = []
    for token in TOKEN.findall(text):
        raw = BRACKET.fullmatch(token)[1] if token[0] == "[" else token
        symbols.append(raw.capitalize())
    n = Counter(symbols)
    elements = [n[s] for s in ("C", "N", "O", "S", "P", "F", "Cl", "Br", "I")]
    heavy = sum(v for s, v in n.items() if s not in ("H", "*"))
    return [*elements, sum(n[s] for s in ("F", "Cl", "Br", "I")), heavy, heavy + n["*"], n["N"] + n["O"]]


SMILES = st.text(st.sampled_from("[[]]ClBrNnOoHhsSeI*1230@+-é日"), max_size=30)


@settings(max_examples=1500, deadline=None)
@given(st.lists(SMILES, min_size=1, max_size=5))
def test_counts_are_those_of_the_tokens(texts):
    column = pa.array(["[C", *texts, "l]"], pa.string()).slice(1, len(texts))
    assert element_counts(column).tolist() == [plain(t) for t in texts]


def test_nulls_and_other_columns(spark):
    rows = [(1, "CC(=O)[O-]", "x"), (2, None, "y"), (3, "", "z"), (4, "[13C@@H](Cl)[nH][se][H][*]Br", None)]
    frame = spark.createDataFrame(rows, "id int, smile string, CarbonCounted string")
    found = {r.id: r for r in with_census(frame, "smile").collect()}
    for k, text, other in rows:
        assert found[k].CarbonCounted == other
        want = [None] * 13 if text is None else plain(text)
        assert [found[k][n] for n in COUNT_NAMES] == want
    assert element_census(frame.limit(0), "id", "smile").count() == 0
