"""Per-protein sequence features."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairwise.constants import MAX_LAG, PROPERTY_NAMES, RESIDUES
from pairwise.functions import sequence

BLOCK = 4 << 20  # letters of a block of a long sequence

_FEATURES = "accession string, sequence_length bigint, sequence_vector array<double>"


def sequence_features(proteins: DataFrame, block: int = BLOCK) -> DataFrame:
    """``accession, sequence_length, sequence_vector``.

    Sequences of up to ``block`` bytes are counted where they are, batch by batch, without a shuffle. A longer
    one is cut into blocks with ten letters of the next one each; the blocks are dealt to all tasks and
    their counts are added, so its length is bounded by no task.
    """
    picked = proteins.select(F.col("accession").cast("string").alias("accession"), "sequence")
    long = F.coalesce(F.octet_length("sequence"), F.lit(0)) > block
    whole = picked.filter(~long).mapInArrow(_whole, _FEATURES)
    cut = picked.filter(long).mapInArrow(_cutter(block), "id bigint, accession string, own bigint, body string")
    counted = cut.repartition("id", F.monotonically_increasing_id()).mapInArrow(
        _count_blocks, "id bigint, accession string, letters binary, pairs binary"
    )
    added = counted.groupBy("id").applyInArrow(_add_blocks, _FEATURES)
    return whole.unionByName(added)


def _features(accession: pa.Array, letters: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    columns = [accession, pa.array(letters.sum(axis=1)), sequence.as_lists(sequence.vectors(letters, pairs, weights))]
    return pa.RecordBatch.from_arrays(columns, ["accession", "sequence_length", "sequence_vector"])


def _whole(batches):
    weights = sequence.pair_weights()
    for batch in batches:
        for part in sequence.parts(batch, "sequence"):
            coded = sequence.coded(part.column("sequence"))
            letters, pairs = sequence.letter_counts(coded), sequence.pair_counts(coded)
            yield _features(part.column("accession"), letters, pairs, weights)


def _cutter(block: int):
    """Blocks of each sequence, numbered by task and row, with the number of letters of their own."""

    def cut(batches):
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for accession, body in zip(batch.column("accession").to_pylist(), batch.column("sequence").to_pylist(), strict=True):
                made += 1
                for start in range(0, len(body), block):
                    part = body[start : start + block + MAX_LAG]
                    columns = [
                        pa.array([made], pa.int64()), pa.array([accession], pa.string()),
                        pa.array([min(block, len(body) - start)], pa.int64()), pa.array([part], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "accession", "own", "body"])

    return cut


def _count_blocks(batches):
    """Counts of blocks; neighbouring blocks of one sequence are added before they are sent."""
    held = None

    def sent():
        columns = [
            pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.string()),
            pa.array([held[2].tobytes()], pa.binary()), pa.array([held[3].tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "accession", "letters", "pairs"])

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            key, own = row.column("id")[0].as_py(), row.column("own").to_numpy()
            coded = sequence.coded(row.column("body"))
            letters, pairs = sequence.letter_counts(coded, own)[0], sequence.pair_counts(coded, own)[0]
            if held and held[0] == key:
                held[2][:] += letters
                held[3][:] += pairs
            else:
                if held:
                    yield sent()
                held = (key, row.column("accession")[0].as_py(), letters, pairs)
    if held:
        yield sent()


def _add_blocks(table: pa.Table) -> pa.Table:
    letters = sum(np.frombuffer(x, np.int64) for x in table.column("letters").to_pylist())
    pairs = sum(np.frombuffer(x, np.int64) for x in table.column("pairs").to_pylist())
    made = _features(
        table.column("accession").combine_chunks().slice(0, 1),
        letters[None], pairs.reshape(1, MAX_LAG, sequence.PAIRS), sequence.pair_weights(),
    )
    return pa.Table.from_batches([made])


def residue_counts(proteins: DataFrame) -> DataFrame:
    """``accession, letters``: the length and the number of each residue, in one pass over the letters."""

    def count(batches):
        for batch in batches:
            for part in sequence.parts(batch, "sequence"):
                letters = sequence.letter_counts(sequence.coded(part.column("sequence")))
                row = np.concatenate([letters.sum(axis=1)[:, None], letters[:, :-1]], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("accession"), sequence.as_lists(row)], ["accession", "letters"])

    picked = proteins.select(F.col("accession").cast("string").alias("accession"), "sequence")
    return picked.mapInArrow(count, "accession string, letters array<bigint>")


def composition(proteins: DataFrame) -> DataFrame:
    """Length and residue shares as columns."""
    n = F.get("letters", F.lit(0))
    shares = [
        F.coalesce(F.try_divide(F.get("letters", F.lit(k)), n), F.lit(0.0)).alias(f"AA_{aa}")
        for k, aa in enumerate(RESIDUES, 1)
    ]
    return residue_counts(proteins).select("accession", n.alias("sequence_length"), *shares)


def lag_values(features: DataFrame) -> DataFrame:
    """One row per protein and lag with the three property values."""
    first = 1 + len(RESIDUES)
    vector = F.col("sequence_vector")
    lags = F.sequence(F.lit(1), F.lit(MAX_LAG))
    values = [
        F.get(vector, F.col("lag") + (first - 1 + k * MAX_LAG)).alias(name.lower())
        for k, name in enumerate(PROPERTY_NAMES)
    ]
    return (
        features.select("accession", "sequence_vector", F.explode(lags).alias("lag"))
        .select("accession", "lag", *values)
    )


def residue_usage(proteins: DataFrame) -> DataFrame:
    """Occurrences of each residue over all sequences, with its standardised properties."""

    def total(batches):
        counts = np.zeros(len(RESIDUES), np.int64)
        for batch in batches:
            for part in sequence.parts(batch, "sequence"):
                letters = sequence.letter_counts(sequence.coded(part.column("sequence")))
                counts += letters[:, :-1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(RESIDUES)), pa.array(counts)], ["residue", "n"])

    counted = proteins.select("sequence").mapInArrow(total, "residue string, n bigint")
    totals = counted.groupBy("residue").agg(F.sum("n").alias("occurrences"))
    return sequence.residue_table(proteins.sparkSession).join(totals, "residue", "left").fillna(0, ["occurrences"])

