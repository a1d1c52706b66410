"""Run a query in Spark and its SQL in DuckDB and compare them as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


def compare(frame, db, sql):
    """None if both give the same rows, else a description of the difference."""
    result = db.execute(sql)
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]) for column in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns: spark {sorted(frame.columns)} sql {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {
        name: (kind, types[name])
        for name, kind in frame.dtypes
        if kinds.get(kind, kind) != types[name]
    }
    if wrong:
        return f"types: {wrong}"
    order = [names.index(name) for name in frame.columns]
    want = Counter(tuple(normal(row[i]) for i in order) for row in expected)
    have = Counter(tuple(map(normal, row)) for row in frame.collect())
    if have != want:
        extra, missing = have - want, want - have
        return (
            f"{sum(have.values())} rows in spark, {sum(want.values())} in sql; "
            f"{sum(extra.values())} differ\nspark: {str(next(iter(extra), None))[:600]}"
            f"\nsql:   {str(next(iter(missing), None))[:600]}"
        )
    return None
