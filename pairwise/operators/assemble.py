"""Attach entity features to the original rows and lay out the output tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairwise.constants import DESCRIPTOR_DIM, PROFILE_DIM, SEQUENCE_DIM
from pairwise.functions.names import compound_names, profile_names, sequence_names

VECTORS = ["sequence_vector", "profile_vector", "compound_vector"]


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def protein_features(sequences: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sequence features with the profile vector; zeros and ``False`` where there is no profile."""
    return sequences.join(profiles, "accession", "left").select(
        "accession",
        "sequence_length",
        F.col("profile_vector").isNotNull().alias("pssm_available"),
        "sequence_vector",
        F.coalesce("profile_vector", _zeros(PROFILE_DIM)).alias("profile_vector"),
    )


def with_own_length(rows: DataFrame) -> DataFrame:
    """Replace the sequence by its length, all that the joins need of it.

    Done before the joins: no output holds the sequence, so no shuffle should carry it.
    """
    length = F.coalesce(F.length("sequence"), F.lit(0)).cast("long")
    return rows.withColumn("own_length", length).drop("sequence")


def attach_proteins(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Left join on the accession; a miss keeps ``own_length`` and has zeros elsewhere.

    The join type is left to the optimizer: broadcast if the features are small, else a sort-merge
    join whose hot partitions are split at run time.
    """
    own = F.col("own_length")
    missing = F.concat(F.array(own.cast("double")), _zeros(SEQUENCE_DIM - 1))
    return rows.join(features, "accession", "left").withColumns(
        {
            "sequence_length": F.coalesce("sequence_length", own),
            "pssm_available": F.coalesce("pssm_available", F.lit(False)),
            "sequence_vector": F.coalesce("sequence_vector", missing),
            "profile_vector": F.coalesce("profile_vector", _zeros(PROFILE_DIM)),
        }
    )


def attach_compounds(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Left join on the compound; a miss has zeros.

    The join is a sort-merge join by a hint: Spark takes an array for one value of its kind, so by its estimate
    millions of vectors of 64 are small enough to broadcast, and every task would hold them all. Hot keys are split
    at run time.
    """
    return rows.join(features.hint("merge"), "compound_cid", "left").withColumn(
        "compound_vector", F.coalesce("compound_vector", _zeros(DESCRIPTOR_DIM))
    )


def _with_first_row(features: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Entity features plus the entity's first row; entities without features stay."""
    firsts = rows.groupBy(key).agg(F.min("row_no").alias(name))
    return firsts.join(features, key, "left")


def assemble(
    rows: DataFrame, proteins: DataFrame, compounds: DataFrame, flagged: bool = False
) -> DataFrame:
    """All rows with their three vectors.

    Compounds first: their vectors are a quarter of the protein vectors, so the second shuffle
    moves less. The vectors stay arrays up to the sink. ``flagged`` adds the first-occurrence flags;
    the first rows travel with the features, so the flags cost no further join of the rows.
    """
    narrow = with_own_length(rows)
    if not flagged:
        return attach_proteins(attach_compounds(narrow, compounds), proteins)
    proteins = _with_first_row(proteins, rows, "accession", "_protein_row")
    compounds = _with_first_row(compounds, rows, "compound_cid", "_compound_row")
    joined = attach_proteins(attach_compounds(narrow, compounds), proteins)
    return joined.withColumns(
        {
            "protein_is_unique": F.col("row_no") == F.col("_protein_row"),
            "compound_is_unique": F.col("row_no") == F.col("_compound_row"),
        }
    ).drop("_protein_row", "_compound_row")


def expand(vector: str, names: list[str]) -> list[Column]:
    """Vector positions as named columns; a short vector is filled with 0.

    SQL text, because hundreds of nested Python column calls take seconds to build.
    """
    return [
        F.expr(f"coalesce(get({vector}, {i}), 0.0D) AS `{name}`") for i, name in enumerate(names)
    ]


def combined_columns(by_lag: bool = False) -> list[Column]:
    """Accession, protein features, compound, compound features, label: 338 columns."""
    return [
        F.col("accession").alias("Protein_Accession"),
        *expand("sequence_vector", sequence_names()),
        *expand("profile_vector", profile_names(by_lag)),
        F.col("compound_cid").alias("Compound_CID"),
        *expand("compound_vector", compound_names()),
        F.col("label").alias("Label"),
    ]


def detailed_columns() -> list[Column]:
    """Row number, ids, compound string, length, profile flag, features, label: 342 columns."""
    return [
        F.col("row_no").alias("Original_Row_Number"),
        F.col("accession").alias("Protein_Accession"),
        F.col("compound_cid").alias("Compound_CID"),
        F.col("smile").alias("Smile"),
        F.col("sequence_length").alias("Sequence_Length"),
        F.col("pssm_available").alias("PSSM_Available"),
        *expand("sequence_vector", sequence_names()),
        *expand("profile_vector", profile_names()),
        *expand("compound_vector", compound_names()),
        F.col("label").alias("Label"),
    ]


def flagged_columns() -> list[Column]:
    """The older detailed layout with both uniqueness flags: 344 columns."""
    return [
        F.col("accession").alias("Protein_Accession"),
        F.col("compound_cid").alias("Compound_CID"),
        F.col("smile").alias("Smile"),
        F.col("sequence_length").alias("Sequence_Length"),
        F.col("pssm_available").alias("PSSM_Available"),
        F.col("row_no").alias("Row_Number"),
        F.col("protein_is_unique").alias("Protein_Is_Unique"),
        F.col("compound_is_unique").alias("Compound_Is_Unique"),
        *expand("sequence_vector", sequence_names()),
        *expand("profile_vector", profile_names(by_lag=True)),
        *expand("compound_vector", compound_names()),
        F.col("label").alias("Label"),
    ]


def feature_usage(assembled: DataFrame) -> DataFrame:
    """``block, idx, nonzero``: rows in which each value of the three vectors is not zero.

    A task adds up its batches and sends one row for each value; missing values are not counted, NaN is.
    """

    def count(batches):
        sums = {name: np.zeros(0, np.int64) for name in VECTORS}
        for batch in batches:
            for name in VECTORS:
                column = batch.column(name)
                values = column.flatten()
                size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
                used = (values.to_numpy(zero_copy_only=False) != 0) & values.is_valid().to_numpy(zero_copy_only=False)
                counts = np.bincount(place, weights=used).astype(np.int64)
                longer = np.zeros(max(len(counts), len(sums[name])), np.int64)
                longer[: len(counts)] += counts
                longer[: len(sums[name])] += sums[name]
                sums[name] = longer
        for name, counts in sums.items():
            block = name.removesuffix("_vector")
            columns = [pa.array([block] * len(counts), pa.string()), pa.array(np.arange(len(counts))), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "idx", "n"])

    counted = assembled.select(*VECTORS).mapInArrow(count, "block string, idx bigint, n bigint")
    return counted.groupBy("block", "idx").agg(F.sum("n").alias("nonzero"))
