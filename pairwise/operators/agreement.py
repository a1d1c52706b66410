"""Agreement of models on their positive pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairwise.functions.scalar import percent, stable_mean
from pairwise.operators.pairs import PAIR, model_list

BLOCK = 512  # models of a block; a product of two blocks has 2 MB
MATRICES = 64  # products that a task holds
LISTS = 2048  # lists of models that are multiplied at a time


def is_positive() -> Column:
    """The prediction's integer part is 1; NaN is not."""
    return (F.col("prediction") >= 1) & (F.col("prediction") < 2)


def positives(predictions: DataFrame) -> DataFrame:
    """Distinct positive pairs per model."""
    hits = predictions.filter(is_positive())
    return hits.select("model_type", "model_name", *PAIR).distinct()


def _hits(predictions: DataFrame, model: tuple[str, str]) -> DataFrame:
    kind, name = model
    of_model = (F.col("model_type") == kind) & (F.col("model_name") == name)
    return predictions.filter(of_model & is_positive()).select(*PAIR)


def positive_intersection(predictions: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """Pairs that both models, given as (type, name), call positive."""
    return _hits(predictions, first).intersect(_hits(predictions, second))


def positive_union(predictions: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """Pairs that at least one of two models calls positive."""
    return _hits(predictions, first).union(_hits(predictions, second)).distinct()


def positive_rates(predictions: DataFrame) -> DataFrame:
    """Records, distinct positive pairs and their ratio in percent, per model."""
    return (
        predictions.groupBy("model_type", "model_name", *PAIR)
        .agg(F.count("*").alias("n"), F.max(is_positive().cast("int")).alias("hit"))
        .groupBy("model_type", "model_name")
        .agg(F.sum("n").alias("predictions"), F.sum("hit").alias("positive_pairs"))
        .withColumn("positive_rate", percent(F.col("positive_pairs"), F.col("predictions")))
    )


def numbered_models(predictions: DataFrame) -> DataFrame:
    """Models with an index from 0, in name order; the list has one row per model."""
    order = Window.orderBy("model_type", "model_name")
    return model_list(predictions).withColumn("index", F.row_number().over(order) - 1)


def overlap_counts(predictions: DataFrame, models: DataFrame, n: int) -> DataFrame:
    """``a, b, shared``: pairs that models ``a`` and ``b`` both call positive, where there are any.

    The models of a pair become a sorted list of their indexes (sets combine before the shuffle, so repeats
    and frequent pairs cost nothing extra), and equal lists are counted. Lists times their counts are then
    multiplied as a 0/1 matrix with itself, in blocks of models: each task adds up its own products and
    sends one small matrix for each two blocks, which are added block by block. The number of models is
    data: it changes neither the plan nor the number of rows that are shuffled, and no pairs of models are
    emitted before the result.
    """
    # models: one row per model
    hits = predictions.filter(is_positive()).join(
        F.broadcast(models.select("model_type", "model_name", F.col("index").cast("int").alias("index"))),
        ["model_type", "model_name"],
    )
    lists = hits.groupBy(*PAIR).agg(F.sort_array(F.collect_set("index")).alias("members"))
    counted = lists.groupBy("members").agg(F.count("*").alias("pairs"))
    width = max(1, min(BLOCK, n))
    products = counted.select("members", "pairs").mapInArrow(_multiplier(width), "i int, j int, product binary")
    dealt = products.repartition("i", "j").sortWithinPartitions("i", "j")
    return dealt.mapInArrow(_matrix_adder(width), "a int, b int, shared bigint")


def _multiplier(width: int):
    """Products of the lists of a task by pairs of blocks of models, each block ``width`` models wide."""

    def multiply(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, LISTS):
                part = batch.slice(start, LISTS)
                members = part.column("members")
                model = members.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), members.value_lengths().to_numpy(zero_copy_only=False))
                pairs = part.column("pairs").to_numpy().astype(float)
                block = model // width
                dense = {}
                for k in np.unique(block).tolist():
                    own = block == k
                    dense[k] = np.zeros((part.num_rows, width))
                    dense[k][row[own], model[own] % width] = 1.0
                for i, left in dense.items():
                    weighted = (left * pairs[:, None]).T
                    for j, right in dense.items():
                        if j >= i:
                            product = np.rint(weighted @ right).astype(np.int64)
                            held[i, j] = held[i, j] + product if (i, j) in held else product
                if len(held) > MATRICES:
                    yield _matrices(held)
                    held = {}
        yield _matrices(held)

    return multiply


def _matrices(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    columns = [
        pa.array([i for i, _ in held], pa.int32()), pa.array([j for _, j in held], pa.int32()),
        pa.array([m.tobytes() for m in held.values()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "product"])


def _matrix_adder(width: int):
    """Streams (i, j, product) sorted by block pair: the cells of each sum, and their mirror images."""

    def cells(key, total):
        a, b = np.nonzero(total)
        shared = total[a, b]
        a, b = a + key[0] * width, b + key[1] * width
        if key[0] != key[1]:
            a, b, shared = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([shared, shared])
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(shared)], ["a", "b", "shared"]
        )

    def add(batches):
        key, total = None, None
        for batch in batches:
            for i, j, product in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                matrix = np.frombuffer(product, np.int64).reshape(width, width)
                if (i, j) == key:
                    total += matrix
                else:
                    if key:
                        yield cells(key, total)
                    key, total = (i, j), matrix.copy()
        if key:
            yield cells(key, total)

    return add


def jaccard(predictions: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Long n x n matrix of model agreement.

    Diagonal 1, empty union 0. ``coverage_a`` is the shared part of a's positives. ``models`` (from
    ``numbered_models``) saves the pass that lists them; its row count is the matrix width, so it
    is read on the driver.
    """
    models = models if models is not None else numbered_models(predictions)
    listed = models.orderBy("index").collect()
    n = len(listed)
    spark = predictions.sparkSession
    names = spark.createDataFrame(
        [(m["model_type"], m["model_name"], m["model"], m["index"]) for m in listed],
        "model_type string, model_name string, model string, index int",
    )
    shared = overlap_counts(predictions, names, n)
    sizes = shared.filter("a = b").select(F.col("a").alias("i"), F.col("shared").alias("size"))
    cells = names.select(
        F.col("index").alias("a"),
        F.col("model").alias("model_a"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"),
    )
    others = names.select(F.col("index").alias("b"), F.col("model").alias("model_b"))
    named = cells.join(others, "b")
    full = (
        named.join(shared, ["a", "b"], "left")
        .join(sizes.select(F.col("i").alias("a"), F.col("size").alias("size_a")), "a", "left")
        .join(sizes.select(F.col("i").alias("b"), F.col("size").alias("size_b")), "b", "left")
        .fillna(0, ["shared", "size_a", "size_b"])
    )
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    ratio = F.coalesce(F.try_divide(F.col("shared"), union), F.lit(0.0))
    return full.select(
        "a",
        "b",
        "model_a",
        "model_b",
        "shared",
        union.alias("union_size"),
        F.when(F.col("a") == F.col("b"), 1.0).otherwise(ratio).alias("jaccard"),
        F.coalesce(F.try_divide("shared", "size_a"), F.lit(0.0)).alias("coverage_a"),
        F.coalesce(F.try_divide("shared", "size_b"), F.lit(0.0)).alias("coverage_b"),
    )


def jaccard_summary(matrix: DataFrame) -> DataFrame:
    """Mean, minimum and maximum off the diagonal; no row unless some value is positive."""
    value = F.col("jaccard")
    return (
        matrix.filter("a <> b")
        .agg(
            F.avg(value).alias("mean_jaccard"),
            F.min(value).alias("min_jaccard"),
            F.max(value).alias("max_jaccard"),
        )
        .filter("max_jaccard > 0")
    )


def jaccard_extremes(matrix: DataFrame) -> DataFrame:
    """Most and least similar model pair; the first in row order on ties."""
    pair = F.struct("model_a", "model_b", "jaccard")
    row = matrix.filter("a <> b").agg(
        F.max_by(pair, F.struct("jaccard", -F.col("a"), -F.col("b"))).alias("most"),
        F.min_by(pair, F.struct("jaccard", "a", "b")).alias("least"),
        F.max("jaccard").alias("_top"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), f"{k}.model_a", f"{k}.model_b", f"{k}.jaccard")
            for k in ("most", "least")
        ]
    )
    return row.filter("_top > 0").select(F.inline(rows))


def complementarity(matrix: DataFrame) -> DataFrame:
    """Mean similarity to the other models and what it suggests for the ensemble.

    No rows unless some two models agree on a pair, as in ``jaccard_summary``.
    """
    mean = F.col("mean_similarity")
    verdict = F.when(mean < 0.5, "keep").when(mean > 0.8, "redundant").otherwise("suitable")
    means = (
        matrix.filter("a <> b")
        .groupBy("a", F.col("model_a").alias("model"))
        .agg(stable_mean(F.col("jaccard")).alias("mean_similarity"), F.max("jaccard").alias("_top"))
    )
    some = F.max("_top").over(Window.partitionBy()) > 0  # one row for each model
    return means.withColumn("_some", some).filter("_some").select(
        "model", "mean_similarity", verdict.alias("verdict")
    )
