"""The engine's input relations derived from the benchmark tables, in Spark and in DuckDB SQL.

Every relation uses all rows and whole texts of its table. Keys are built so that the number of
proteins and compounds grows with the tables.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwise.sources.interactions import clean_fields


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("M"), "l_linestatus").alias("model_type"),
        F.concat(F.lit("m"), "l_linenumber").alias("model_name"),
        F.concat(F.lit("P"), "l_suppkey").alias("protein_id"),
        F.concat(F.lit("C"), F.col("l_partkey") % 100).alias("compound_id"),
        F.when(share >= 0.5, 1).otherwise(0).alias("prediction"),
        (1 - share).alias("probability_0"),
        share.alias("probability_1"),
        F.greatest(share, 1 - share).alias("confidence"),
    )


PREDICTIONS = """
fx_predictions AS (
  SELECT concat('M', l_linestatus) AS model_type, concat('m', l_linenumber) AS model_name,
         concat('P', l_suppkey) AS protein_id, concat('C', l_partkey % 100) AS compound_id,
         CASE WHEN l_quantity / 50 >= 0.5 THEN 1 ELSE 0 END AS prediction,
         1 - l_quantity / 50 AS probability_0, l_quantity / 50 AS probability_1,
         greatest(l_quantity / 50, 1 - l_quantity / 50) AS confidence
  FROM lineitem)"""


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned rows: three rows share a protein, two share a compound, texts differ.

    Some rows have no accession or no compound id.
    """
    some_id = F.concat(F.lit(" P"), F.expr("doc_id div 3"), F.lit("\t"))
    some_compound = F.concat(F.lit("C"), F.expr("doc_id div 2"), F.lit(" "))
    return documents(spark, sf_dir, "doc_id", "text", "n_chars").select(
        (F.col("doc_id") + 1).alias("row_no"),
        F.when(F.col("doc_id") % 97 != 5, some_id).alias("accession"),
        F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence"),
        F.when(F.col("doc_id") % 89 != 7, some_compound).alias("compound_cid"),
        F.concat(F.lit("\n"), "text").alias("smile"),
        (F.col("n_chars") % 2).cast("string").alias("label"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_fields(raw_interactions(spark, sf_dir))


# Trimmed characters: the same list as the engine's.
SPACES = "' ' || " + " || ".join(
    f"chr({n})"
    for n in [*range(9, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)

INTERACTIONS = f"""
fx_interactions AS (
  SELECT doc_id + 1 AS row_no,
         CASE WHEN doc_id % 97 = 5 THEN '' ELSE concat('P', doc_id // 3) END AS accession,
         upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence,
         CASE WHEN doc_id % 89 = 7 THEN '' ELSE concat('C', doc_id // 2) END AS compound_cid,
         trim(text, {SPACES}) AS smile, CAST(n_chars % 2 AS VARCHAR) AS label
  FROM documents)"""


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of 1, 2 … 12 positions, over and over: 78 rows make twelve proteins.

    A vector of 64 values makes four rows of 20 scores, the last one filled with zeros.
    """
    chunk = F.concat(F.slice("embedding", F.col("k") * 20 + 1, 20), F.array_repeat(F.lit(0.0).cast("float"), 16))
    rest = F.col("r") % 78
    nth = F.floor((F.sqrt(rest * 8 + 1) - 1) / 2)
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        .select((F.col("vec_id") * 4 + F.col("k")).alias("r"), F.slice(chunk, 1, 20).alias("chunk"))
        .select("r", "chunk", rest.alias("rest"), nth.alias("nth"))
        .select(
            F.concat(F.lit("P"), F.expr("r div 78") * 12 + F.col("nth")).alias("accession"),
            F.expr("rest - nth * (nth + 1) div 2 + 1").alias("pos"),
            F.col("chunk").cast("array<double>").alias("scores"),
        )
    )


PROFILE_ROWS = """
fx_chunk AS (
  SELECT vec_id * 4 + k AS r, list_resize(CAST(embedding[k * 20 + 1 : k * 20 + 20] AS DOUBLE[]), 20, 0.0) AS scores
  FROM embeddings, range(4) AS t(k)),
fx_nth AS (
  SELECT *, r % 78 AS rest, CAST(floor((sqrt((r % 78) * 8 + 1) - 1) / 2) AS BIGINT) AS nth
  FROM fx_chunk),
fx_profile AS (
  SELECT concat('P', r // 78 * 12 + nth) AS accession, rest - nth * (nth + 1) // 2 + 1 AS pos, scores
  FROM fx_nth)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of which some are missing (NaN)."""
    key, nan = F.col("p_partkey"), F.lit(float("nan"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("C"), "p_partkey").alias("compound_cid"),
        F.when(key % 37 == 0, nan).otherwise((key % 500 + 120).cast("double")).alias("MW"),
        F.when(key % 43 == 1, nan).otherwise((F.col("p_size") - 25).cast("double") / 5).alias("LogP"),
        (F.col("p_size") % 14).alias("HBA"),
        (F.col("p_size") % 8).alias("HBD"),
        (F.col("p_size") % 13).alias("RotBonds"),
        (F.col("p_size") + 5).alias("AtomCount"),
        F.when(key % 41 == 3, nan).otherwise((key * 7 % 200).cast("double")).alias("TPSA"),
        F.col("p_retailprice").alias("MR"),
    )


DESCRIPTORS = """
fx_descriptors AS (
  SELECT concat('C', p_partkey) AS compound_cid,
         CASE WHEN p_partkey % 37 = 0 THEN 'NaN' ELSE CAST(120 + p_partkey % 500 AS DOUBLE) END AS MW,
         CASE WHEN p_partkey % 43 = 1 THEN 'NaN' ELSE CAST(p_size - 25 AS DOUBLE) / 5 END AS LogP,
         p_size % 14 AS HBA, p_size % 8 AS HBD,
         p_size % 13 AS RotBonds, p_size + 5 AS AtomCount,
         CASE WHEN p_partkey % 41 = 3 THEN 'NaN' ELSE CAST((p_partkey * 7) % 200 AS DOUBLE) END AS TPSA,
         p_retailprice AS MR
  FROM part)"""


def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins whose features count as stored: those with a good-quality row."""
    return (
        table(spark, sf_dir, "labels")
        .filter("quality = 1")
        .select(F.concat(F.lit("P"), F.expr("doc_id div 3")).alias("accession"))
        .distinct()
    )


STORE = """
fx_store AS (
  SELECT DISTINCT concat('P', doc_id // 3) AS accession FROM labels WHERE quality = 1)"""
