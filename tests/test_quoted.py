"""CSV files with line breaks in quotes: many splits give what one task gives."""

import csv
import io
import random
from contextlib import contextmanager

import pytest
from hypothesis import given, settings, strategies as st

from pairwise.sources.interactions import read_interactions
from pairwise.sources.quoted import OPEN, QUOTED, line_end, read_lines, split_starts

HEADER = "ProteinID,Seq,CID,SMILES,Class"


@contextmanager
def splits_of(spark, size):
    settings_ = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in settings_}
    for key, value in settings_.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def one_task(spark, path, width=5):
    """The cells as Spark's own reader gives them, a file as one task."""
    options = {"header": True, "escape": '"', "multiLine": True}
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return [tuple(r) for r in spark.read.schema(schema).options(**options).csv(path).collect()]


def hostile(n, seed, end):
    rng = random.Random(seed)
    bits = ['""', ",", "\n", end, "\n\n", "x", "long " * 20, "'", "\\", " ", "é", '"",""', f'"",{end}""']
    lines = [HEADER]
    for i in range(n):
        smile = '"' + "".join(rng.choice(bits) for _ in range(rng.randrange(8))) + '"'
        lines.append(f'P{i},"A{end}C{i}",C{i},{smile},{rng.choice(["", "1", chr(34) * 2, "5" + chr(34) + " x"])}')
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["200b", "1k", "1m"])
def test_rows_and_numbers_do_not_depend_on_the_splits(spark, tmp_path, size, end):
    path = tmp_path / "in.csv"
    path.write_bytes(hostile(60, 7, end).encode())
    with splits_of(spark, size):
        rows = read_interactions(spark, str(path), multi_line=True).orderBy("row_no").collect()
        assert size == "1m" or read_lines(spark, [str(path)]).select("block").distinct().count() > 5
    want = one_task(spark, str(path))
    assert [r.row_no for r in rows] == list(range(1, len(want) + 1))
    strip = lambda x: (x or "").strip()
    assert [(r.accession, r.sequence, r.compound_cid, r.smile, r.label) for r in rows] == [
        (a, strip(s).upper(), c, strip(m), strip(y)) for a, s, c, m, y in want
    ]


def test_a_record_longer_than_many_splits(spark, tmp_path):
    path = tmp_path / "in.csv"
    long = "\n".join(f'line {i}, ""quoted""' for i in range(1000))
    path.write_text(f'{HEADER}\nP1,A,C1,S,1\nP2,A,C2,"{long}",0\nP3,A,C3,"{long}\n",1\nP4,A,C4,S,0')
    with splits_of(spark, "2k"):
        rows = read_interactions(spark, str(path), multi_line=True).orderBy("row_no").collect()
    assert [(r.row_no, r.accession) for r in rows] == [(1, "P1"), (2, "P2"), (3, "P3"), (4, "P4")]
    assert rows[1].smile == rows[2].smile == long.replace('""', '"')


def test_many_files_are_numbered_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        text = HEADER + "".join(f'\nP{k}-{i},"A\n{i}",C,S,1' for i in range(40 * k))
        (tmp_path / "in" / f"part {k}.csv").write_text(text)
    with splits_of(spark, "600b"):
        rows = read_interactions(spark, str(tmp_path / "in"), multi_line=True).orderBy("row_no").collect()
    assert [(r.row_no, r.accession) for r in rows] == [
        (n, a) for n, a in enumerate((f"P{k}-{i}" for k in range(4) for i in range(40 * k)), 1)
    ]


def test_a_record_that_lacks_cells_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\nP,"A\n,,,,,",C\n')
    with pytest.raises(Exception, match="missing cells"):
        read_interactions(spark, str(tmp_path / "a.csv"), multi_line=True).collect()


CELLS = st.text(st.sampled_from('ab",\n '), max_size=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(CELLS, min_size=2, max_size=4), min_size=1, max_size=6))
def test_line_ends_follow_a_csv_reader(rows):
    """A record ends where the state of its lines is open, and nowhere else."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    state, records, held = OPEN, [], []
    for line in out.getvalue()[:-1].split("\n"):
        held.append(line)
        state = line_end(line.encode(), state)
        if state == OPEN:
            records.append(next(csv.reader(io.StringIO("\n".join(held)))))
            held = []
    assert records == rows and state == OPEN


@pytest.mark.parametrize(
    ("line", "start", "end"),
    [
        (b'a,"b', OPEN, QUOTED), (b'a,b"c', OPEN, OPEN), (b' "a', OPEN, OPEN), (b'"a""', OPEN, QUOTED), (b'"a"b"c,d', OPEN, OPEN),
        (b"", OPEN, OPEN), (b"", QUOTED, QUOTED), (b'"', QUOTED, OPEN), (b'""', QUOTED, QUOTED), (b'","', QUOTED, QUOTED), (b'x",y', QUOTED, OPEN),
    ],
)
def test_line_end(line, start, end):
    assert line_end(line, start) == end


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=12))
def test_composition_of_split_functions(spark, splits):
    rows = [("f", 10 * k, *s) for k, s in enumerate(splits)]
    schema = "file string, block bigint, from_open int, from_quoted int, begin_open bigint, begin_quoted bigint"
    found = split_starts(spark.createDataFrame(rows, schema)).orderBy("block").collect()
    state, before = OPEN, 0
    for r, (from_open, from_quoted, begin_open, begin_quoted) in zip(found, splits, strict=True):
        assert (r.state, r.before, r.rows) == (state, before, begin_quoted if state else begin_open)
        before += r.rows
        state = from_quoted if state else from_open
