"""Quality classifier: random-indexing word vectors, pooled, under a small network.

1. *Random indexing* over all documents. A token (run of letters and digits, or of other signs) has a sparse
   random index vector. Its context vector is the sum of the index vectors of the tokens up to two places
   away, over every occurrence in the corpus. Tokens share 2**16 rows by hash, so the table has a fixed
   size and tasks add up whole numbers: the sum does not depend on the partitioning.
2. A token's vector is its normalised context vector beside its index vector; a document's is the mean.
   Beside the mean stand its length and the mean product of vectors one and two places apart (high if a text
   repeats itself) and the logarithm of the number of tokens.
3. A network of two layers in numpy is fitted on at most ``max_train_rows`` labelled documents, those of the
   smallest hash of the id. Four fifths train, the rest sets the temperature that the logit is divided by.

Rows are held out if crc32 of the id as text has remainder 2 by 4; their labels are never used. Only the
text enters a score. Null text is empty; an empty text has the zero vector and a score like any other. A
null id is not held out and has no label. Labels that are null are left out; if an id has several, their
mean decides, above a half being good. Without labels, or with one class only, the score is that class's
smoothed share. Repeated documents get equal scores; ids that repeat in training count as often.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairwise.llm.arrow_text import SLICE, encode_runs, extended, flat, hashes, runs, short_batches, slices, without

BUCKETS = 1 << 16
SIZE = 32  # of index and context vectors
NONZERO = 4  # entries of an index vector
REACH = 2  # tokens to either side
MAX_TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
BATCH = 128
THRESHOLD = 0.7
PART = 256  # table rows sent as one
_CHUNK = 1 << 16  # tokens summed at a time


def _sign_table() -> np.ndarray:
    """0 white space, 1 letters and digits, 2 other ASCII."""
    table = np.full(256, 1, np.uint8)
    table[[*range(33), 127]] = 0
    table[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
    return table


_SIGNS = _sign_table()


def index_vectors() -> np.ndarray:
    """A row for each bucket: NONZERO entries, half of them 1 and half -1."""
    order = np.random.default_rng(20).random((BUCKETS, SIZE)).argsort(axis=1)[:, :NONZERO]
    table = np.zeros((BUCKETS, SIZE), np.int8)
    signs = np.where(np.arange(NONZERO) % 2, -1, 1)
    np.put_along_axis(table, order, np.broadcast_to(signs, order.shape).astype(np.int8), axis=1)
    return table


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every token, and where each row's tokens begin."""
    data, offsets = flat(texts)
    kind = _SIGNS[data]
    inside = kind > 0
    starts, ends = runs(inside, offsets, kind)
    codes, vocabulary = encode_runs(data, starts, ends, inside)
    buckets = (hashes(vocabulary) % BUCKETS).astype(np.int64)
    return buckets[codes] if len(codes) else np.zeros(0, np.int64), np.searchsorted(starts, offsets)


def add_contexts(total: np.ndarray, own: np.ndarray, first: np.ndarray, index: np.ndarray) -> None:
    """Add the index vectors of each token's neighbours to its row of ``total``."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for start in range(0, len(own), _CHUNK):
        at = np.arange(start, min(start + _CHUNK, len(own)))
        sums = np.zeros((len(at), SIZE), np.int32)
        for step in (*range(-REACH, 0), *range(1, REACH + 1)):
            near = at + step
            valid = (near >= 0) & (near < len(own))
            valid[valid] = row[near[valid]] == row[at[valid]]
            sums[valid] += index[own[near[valid]]]
        order = np.argsort(own[at], kind="stable")
        sorted_rows = own[at][order]
        begin = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        total[sorted_rows[begin]] += np.add.reduceat(sums[order], begin, axis=0)


def _contexts(batches):
    index, total = index_vectors(), np.zeros((BUCKETS, SIZE), np.int64)
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            add_contexts(total, *tokens(batch.column("text")), index)
    parts = total.reshape(-1, PART * SIZE)
    filled = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled, pa.int64()), pa.array([parts[k].astype("<i8").tobytes() for k in filled], pa.binary())],
        ["part", "sums"],
    )


def _added(batches):
    """Sums of a partition's parts; at most BUCKETS / PART of them."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(sums, "<i8")
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
        ["part", "sums"],
    )


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Context and index vector of each bucket, over all documents: a table of fixed size."""
    schema = "part bigint, sums binary"
    parts = short_batches(df).select(F.col(text).alias("text")).mapInArrow(_contexts, schema)
    total = np.zeros((BUCKETS // PART, PART * SIZE), np.int64)
    for row in parts.repartition("part").mapInArrow(_added, schema).collect():
        total[row["part"]] = np.frombuffer(row["sums"], "<i8")
    context = total.reshape(BUCKETS, SIZE).astype(np.float64)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    context /= np.where(length > 0, length, 1)
    return np.concatenate([context, index_vectors() / np.sqrt(NONZERO)], axis=1).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean token vector of each text, then its length, mean products of tokens one and two apart, log count."""
    own, first = tokens(texts)
    size = vectors.shape[1]
    out = np.zeros((len(texts), size + 4))
    for k in range(len(texts)):
        start, end = first[k], first[k + 1]
        for a in range(start, end, _CHUNK):
            b = min(a + _CHUNK, end)
            near = vectors[own[a : min(b + 2, end)]]
            out[k, :size] += near[: b - a].sum(axis=0, dtype=np.float64)
            for step in (1, 2):
                ahead = near[step : b - a + step]
                out[k, size + step] += np.einsum("ij,ij->", near[: len(ahead)], ahead, dtype=np.float64)
    count = np.diff(first)
    out[:, :size] /= np.maximum(count, 1)[:, None]
    for step in (1, 2):
        out[:, size + step] /= np.maximum(count - step, 1)
    out[:, size] = np.linalg.norm(out[:, :size], axis=1)
    out[:, size + 3] = np.log1p(count)
    return out


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    share: float | None = None  # the score of all, if there was nothing to learn

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(pooled), self.share)
        logits = _logits(self.layers, (pooled - self.mean) / self.scale)[0]
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -60, 60)))


def _logits(layers, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return (hidden @ w2 + b2).ravel(), hidden


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the mean log loss."""
    rng = np.random.default_rng(7)
    layers = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)),
        np.zeros(1),
    ]
    m, v, step = [0.0] * 4, [0.0] * 4, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for rows in np.array_split(order, max(1, len(x) // BATCH)):
            logits, hidden = _logits(layers, x[rows])
            error = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - y[rows])[:, None] / len(rows)
            back = (error @ layers[2].T) * (hidden > 0)
            slopes = (x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))
            step += 1
            for k, slope in enumerate(slopes):
                slope = slope + 1e-4 * layers[k]
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.999 * v[k] + 0.001 * slope**2
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                layers[k] = layers[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)
    return tuple(layers)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, over a grid of factors."""
    def loss(t: float) -> float:
        z = np.clip(logits / t, -60, 60)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return float(min(np.geomspace(0.25, 16, 97), key=loss)) if len(y) else 1.0


def fit(vectors: np.ndarray, pooled: np.ndarray, y: np.ndarray) -> Model:
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(vectors, np.zeros(0), np.zeros(0), (), 1.0, float(share))
    mean, scale = pooled.mean(axis=0), pooled.std(axis=0) + 1e-3
    x = (pooled - mean) / scale
    tuning = np.arange(len(y)) % 5 == 4
    layers = fit_network(x[~tuning], y[~tuning])
    return Model(vectors, mean, scale, layers, calibrate(_logits(layers, x[tuning])[0], y[tuning]))


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, target: str, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents outside the held-out fold."""
    known = labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull() & ~held_out(key))
    chosen = (
        known.groupBy(F.col(key).cast("bigint").alias("doc_id"))
        .agg((F.avg(target) > 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers


def _pooler(vectors):
    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                made = pool(batch.column("text"), vectors.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in made], pa.binary())],
                    ["doc_id", "label", "pooled"],
                )

    return rows


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target: str = "quality",
    max_train_rows: int = MAX_TRAIN_ROWS,
) -> Model:
    spark: SparkSession = docs.sparkSession
    vectors = word_vectors(docs, text)
    shared = spark.sparkContext.broadcast(vectors)
    chosen = training_rows(docs, labels, key, text, target, max_train_rows)
    pooled = chosen.mapInArrow(_pooler(shared), "doc_id bigint, label int, pooled binary")
    # ids that repeat may bring more rows than labels were chosen
    rows = pooled.orderBy(F.xxhash64("doc_id"), "doc_id", "pooled").limit(max_train_rows).collect()
    shared.unpersist()
    x = np.array([np.frombuffer(r["pooled"]) for r in rows])
    return fit(vectors, x, np.array([r["label"] for r in rows], np.float64))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", column: str = "score") -> DataFrame:
    """All columns, and the probability of label 1; a column of that name is replaced."""
    df = short_batches(without(df, column))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                made = shared.value.scores(pool(batch.column(text), shared.value.vectors))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, column]
                )

    return df.mapInArrow(rows, extended(df, T.StructField(column, T.DoubleType())))
