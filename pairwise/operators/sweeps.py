"""Counts of pairs over free grids of thresholds, by one summed-area table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairwise.operators.consensus import CONFIDENCE, PROBABILITY

CELLS = 1 << 16  # filled cells that a task holds before it sends them


def grid_counts(stats: DataFrame, probabilities: list[float], confidences: list[float], levels: list[int]) -> DataFrame:
    """``i, j, k, pairs``: filled cells of the grid.

    A pair stands in the cell of the number of thresholds that its mean probability, its mean confidence and
    its positive predictions reach. NaN reaches none. Each task counts its pairs in a sparse table of cells
    and sends that; thresholds are data of the function, not of the plan.
    """
    edges = [np.sort(np.asarray(x, float)) for x in (probabilities, confidences, levels)]
    shape = [len(e) + 1 for e in edges]

    def count(batches):
        held: dict[int, int] = {}
        for batch in batches:
            places = []
            for column, edge in zip(range(3), edges, strict=True):
                value = batch.column(column).to_numpy(zero_copy_only=False).astype(float)
                places.append(np.where(np.isnan(value), 0, np.searchsorted(edge, value, "right")))
            cells, counts = np.unique(np.ravel_multi_index(places, shape), return_counts=True)
            for cell, n in zip(cells.tolist(), counts.tolist(), strict=True):
                held[cell] = held.get(cell, 0) + n
            if len(held) > CELLS:
                yield told(held)
                held = {}
        yield told(held)

    def told(held):
        at = np.unravel_index(np.fromiter(held, np.int64, len(held)), shape)
        counts = np.fromiter(held.values(), np.int64, len(held))
        columns = [*(pa.array(x.astype(np.int32)) for x in at), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["i", "j", "k", "n"])

    picked = stats.select(PROBABILITY, CONFIDENCE, F.col("positive_predictions").cast("double"))
    counted = picked.mapInArrow(count, "i int, j int, k int, n bigint")
    return counted.groupBy("i", "j", "k").agg(F.sum("n").alias("pairs"))


def threshold_grid(
    stats: DataFrame, probabilities: list[float], confidences: list[float], levels: list[int] = (0,)
) -> DataFrame:
    """``probability, confidence, positives, pairs``: pairs that reach all three thresholds, for each combination.

    The pairs are counted once. Suffix sums of the cells along each of the three axes then give every
    combination, so the work after the count follows the grid and not the pairs. Windows are lines of the grid.
    """
    spark = stats.sparkSession
    axes = [sorted({*map(float, probabilities)}), sorted({*map(float, confidences)}), sorted({*map(int, levels)})]
    counted = grid_counts(stats, *axes).filter("i > 0 and j > 0 and k > 0")
    frames = [
        spark.createDataFrame(list(enumerate(axis, 1)), f"{place} int, {name} {kind}")
        for axis, place, name, kind in zip(
            axes, "ijk", ("probability", "confidence", "positives"), ("double", "double", "int"), strict=True
        )
    ]
    # the grid itself: as many rows as were asked for
    n, at = [len(axis) for axis in axes], F.col("id")
    places = {"i": at % n[0] + 1, "j": F.expr(f"id div {n[0]}") % n[1] + 1, "k": F.expr(f"id div {n[0] * n[1]}") + 1}
    grid = spark.range(n[0] * n[1] * n[2]).select(*[c.cast("int").alias(x) for x, c in places.items()])
    for frame, place in zip(frames, "ijk", strict=True):
        grid = grid.join(frame, place)
    cells = grid.join(counted, ["i", "j", "k"], "left").fillna(0, ["pairs"])
    for axis in "ijk":
        others = [x for x in "ijk" if x != axis]
        line = Window.partitionBy(*others).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("pairs", F.sum("pairs").over(line))
    return cells.select("probability", "confidence", "positives", "pairs")
