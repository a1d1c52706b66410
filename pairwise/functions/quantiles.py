"""Exact quantiles of large groups without gathering or shuffling a group."""

import math

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000  # a sketch is off by at most one part in this many of its rows
GRID = 4_000  # quantiles read from a sketch
SMALL = 65_536  # rows of an interval that are fetched


def exact_quantiles(values: DataFrame, probabilities: list[float], small: int = SMALL) -> DataFrame:
    """``metric, probability, quantile`` with linear interpolation between the two nearest ranks.

    ``values`` has ``metric, value`` without NaN, one row for each observation; there are few metrics.
    It is read in every pass, so it should come from a staged table. The first pass sketches every metric
    (``percentile_approx``, which combines before the shuffle); the sketch gives each wanted rank an interval
    of about a thousandth of the rows. The next pass counts the rows below it and fetches its values with
    their counts, which settles the rank exactly; values that crowd together are one row. Where a
    thousandth is still over ``small`` rows, one more pass sketches the interval. That makes two passes up to
    some 60 million values of a metric and three up to some 60 billion. Counts decide, not the sketch: were
    a rank outside its interval, the pass would say on which side, and the search would go on there.
    """
    spark = values.sparkSession
    totals, known = {}, {}  # metric -> rows; (metric, rank) -> value
    sketch: dict[tuple, set[int]] = {}  # (metric, lo, hi) -> ranks; the bounds, if any, belong to it
    first = _sketched(values, [(None, None, None)])
    for (metric, _, _), (_, _, n, _, _) in first.items():
        totals[metric] = n
        sketch[metric, None, None] = {r for p in probabilities for r in _ranks(p, n)[:2]}
    seen = first
    while sketch:
        fetch: dict[tuple, set[int]] = {}
        again: dict[tuple, set[int]] = {}
        for cell, ranks in sketch.items():
            (metric, lo, hi), (below, at_lo, inside, at_hi, grid) = cell, seen[cell]
            start = below + at_lo
            for rank in ranks:
                if rank < below:
                    again.setdefault((metric, None, lo), set()).add(rank)
                elif rank < start:
                    known[metric, rank] = lo
                elif rank < start + inside:
                    a, b, rows = _bracket(rank - start, inside, lo, hi, grid)
                    (fetch if rows <= small else again).setdefault((metric, a, b), set()).add(rank)
                elif rank < start + inside + at_hi:
                    known[metric, rank] = hi
                else:
                    again.setdefault((metric, hi, None), set()).add(rank)
        for (metric, lo, hi), (below, found) in (_fetched(values, list(fetch)) if fetch else {}).items():
            for rank in fetch[metric, lo, hi]:
                if rank < below:
                    again.setdefault((metric, None, lo), set()).add(rank)
                elif not found or rank >= found[-1][1]:
                    again.setdefault((metric, hi, None), set()).add(rank)
                else:
                    known[metric, rank] = next(v for v, end in found if rank < end)
        sketch = again
        seen = _sketched(values, list(sketch)) if sketch else {}
    rows = []
    for metric, n in totals.items():
        for p in probabilities:
            low, high, weight = _ranks(p, n)
            a, b = known[metric, low], known[metric, high]
            rows.append((metric, p, a + (b - a) * weight if weight else a))
    return spark.createDataFrame(rows, "metric string, probability double, quantile double")


def _ranks(probability: float, total: int) -> tuple[int, int, float]:
    at = probability * (total - 1)
    low = int(at)
    return low, min(low + 1, total - 1) if at > low else low, at - low


def _bracket(rank: int, rows: int, lo: float | None, hi: float | None, grid: list[float]) -> tuple:
    """Bounds around a rank of the sketched rows, and about how many rows are between them."""
    at, margin = (rank + 0.5) / rows, 1.5 / ACCURACY + 1 / rows
    first, last = math.floor((at - margin) * GRID), math.ceil((at + margin) * GRID)
    a, b = grid[first] if first > 0 else lo, grid[last] if last < GRID else hi
    share = (min(last, GRID) - max(first, 0)) / GRID + 2 / ACCURACY
    return a, b, 0 if a is not None and a == b else min(rows, rows * share)


def _with_cells(values: DataFrame, cells: list[tuple]) -> DataFrame:
    """Every row once for each interval of its metric; there are at most two for each probability."""
    numbered = [(k, *cell) for k, cell in enumerate(cells)]
    frame = values.sparkSession.createDataFrame(numbered, "cell int, metric string, lo double, hi double")
    return values.join(F.broadcast(frame), "metric")


def _is(condition: Column, unbounded: bool) -> Column:
    return F.coalesce(condition, F.lit(unbounded))


def _sketched(values: DataFrame, cells: list[tuple]) -> dict[tuple, tuple]:
    """Rows below, at the lower bound, between, at the upper bound, and the quantiles of those between.

    The cell (None, None, None) stands for all rows of each metric.
    """
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    if cells == [(None, None, None)]:
        placed = values.withColumns({"cell": F.lit(0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    else:
        placed = _with_cells(values, cells)
    between = _is(v > lo, True) & _is(v < hi, True)
    one = _is(lo == hi, False)
    places = ",".join(str(k / GRID) for k in range(GRID + 1))  # one literal instead of thousands
    grid = F.split(F.lit(places), ",").cast("array<double>")
    rows = placed.groupBy("metric", "cell").agg(
        F.count_if(_is(v < lo, False)).alias("below"),
        F.count_if(_is(v == lo, False)).alias("at_lo"),
        F.count_if(between).alias("between"),
        F.count_if(_is(v == hi, False) & ~one).alias("at_hi"),
        F.percentile_approx(F.when(between, v), grid, ACCURACY).alias("grid"),
    )
    named = {}
    for r in rows.collect():
        cell = (r["metric"], *cells[r["cell"]][1:])
        named[cell] = (r["below"], r["at_lo"], r["between"], r["at_hi"], r["grid"])
    return named


def _fetched(values: DataFrame, cells: list[tuple]) -> dict[tuple, tuple[int, list[tuple]]]:
    """Rows below each interval, and its values in order, with the rows up to and including each."""
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    kept = _with_cells(values, cells).filter(_is(v <= hi, True))
    below = _is(v < lo, False)
    rows = kept.groupBy("cell", below.alias("below"), F.when(~below, v).alias("value")).count().collect()
    under = {r["cell"]: r["count"] for r in rows if r["below"]}
    found: dict[tuple, tuple[int, list[tuple]]] = {c: (under.get(k, 0), []) for k, c in enumerate(cells)}
    for r in sorted((r for r in rows if not r["below"]), key=lambda r: (r["cell"], r["value"])):
        start, ends = found[cells[r["cell"]]]
        ends.append((r["value"], (ends[-1][1] if ends else start) + r["count"]))
    return found
