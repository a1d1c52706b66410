"""A training-data pipeline over ``documents``.

The classifier drops what it rejects; lines that many documents share go; of each group of near-duplicates
one document stays; documents with passages of the benchmark go; the rest is tokenized. Each stage is
written to the shared folder and read back, so a lost executor costs one stage's tasks at most. Stages
take any columns beside ``doc_id``, ``text`` and ``n_chars`` and pass them on, except where a stage adds a
column of that name; null texts are empty, and a document is a row.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwise.llm import byte_bpe, line_dedup, quality_classifier, simhash_dedup, suffix_arrays
from pairwise.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score 0.7 or more, by a model of the labels outside the held-out fold."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, column="quality_score")
    return scored.filter(F.col("quality_score") >= quality_classifier.THRESHOLD).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others keep; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return suffix_arrays.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids (little-endian 32 bit), n_tokens, and whether decoding gives the text back."""
    decoded = byte_bpe.decode(byte_bpe.encode(docs))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n_tokens = F.expr("octet_length(token_ids) div 4").cast("bigint")
    return decoded.withColumns({"n_tokens": n_tokens, "round_trip": same}).drop("decoded")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None  # a trained network and BPE merges are beyond SQL; the tests hold run() against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES, 1):
        docs = stage(step(spark, docs, sf_dir), f"stage-{k}")
    return docs
