"""Position-specific score profiles in their ASCII form, one file per protein."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairwise.functions.scalar import strip
from pairwise.sources.catalogue import hidden_texts
from pairwise.sources.listing import find_files
from pairwise.sources.runs import decoded_path

SCORES = slice(2, 22)  # tokens of a data row that hold the 20 scores


def safe_name(accession: Column) -> Column:
    """The file stem used for a protein: slash, backslash and pipe become underscores."""
    return F.translate(accession, "/\\|", "___")


def parse_profiles(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, scores`` from whole profile texts.

    A line whose first token is all digits is a data line. Reading ends at the first blank or
    ``Lambda`` line after the first data line. Data lines with fewer than 22 tokens or with a
    score that is no number give no row; ``pos`` numbers the rows that remain.
    """
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda line: strip(line))
    tokens = F.transform(lines, lambda line: F.split(line, r"\s+"))
    parsed = F.transform(
        tokens,
        lambda t: F.struct(
            t[0].rlike("^[0-9]+$").alias("data"),
            ((t[0] == "") | t[0].startswith("Lambda")).alias("stop"),
            F.transform(
                F.slice(t, SCORES.start + 1, SCORES.stop - SCORES.start),
                lambda x: x.try_cast("double"),
            ).alias("scores"),
        ),
    )
    start = F.array_position(F.transform("_lines", lambda r: r["data"]), True).cast("int")
    body = F.slice("_lines", F.greatest(start, F.lit(1)), F.size("_lines"))
    stop = F.array_position(F.transform("_body", lambda r: r["stop"]), True).cast("int")
    kept = F.when(stop > 0, F.slice("_body", F.lit(1), stop - 1)).otherwise(F.col("_body"))
    complete = F.filter(
        kept,
        lambda r: r["data"] & (F.size(r["scores"]) == 20) & F.forall(r["scores"], F.isnotnull),
    )
    return (
        files.select(key, parsed.alias("_lines"))
        .filter(start > 0)
        .select(key, body.alias("_body"))
        .select(key, F.posexplode(complete).alias("pos", "_row"))
        .select(key, (F.col("pos") + 1).alias("pos"), F.col("_row.scores").alias("scores"))
    )


def profile_texts(spark: SparkSession, directory: str) -> DataFrame:
    """``stem, value``: every ``*.pssm`` file as one row, names that begin with ``_`` or ``.`` included."""
    hidden = find_files(spark, f"{directory.rstrip('/')}/[_.]*.pssm")
    files = spark.read.option("pathGlobFilter", "*.pssm").text(directory, wholetext=True)
    name = F.element_at(F.split(decoded_path(F.col("_metadata.file_path")), "/"), -1)
    texts = files.select(name.alias("name"), "value")
    if hidden:
        own = F.element_at(F.split("path", "/"), -1).alias("name")
        texts = texts.unionByName(hidden_texts(spark, hidden).select(own, "value"))
    return texts.select(F.regexp_replace("name", r"\.pssm$", "").alias("stem"), "value")


def read_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """``stem, pos, scores`` for every ``*.pssm`` file; a file is one small row."""
    return parse_profiles(profile_texts(spark, directory), "stem", "value")


def attach_profiles(proteins: DataFrame, texts: DataFrame) -> DataFrame:
    """``accession, pos, scores`` of the proteins that have a profile file.

    Texts are joined before they are parsed, so files of other proteins cost no parsing.
    """
    keys = proteins.select("accession", safe_name(F.col("accession")).alias("stem"))
    return parse_profiles(keys.join(texts, "stem"), "accession", "value")


def with_profile_flag(proteins: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``pssm_available``: is there a profile under the protein's safe name?"""
    stems = profiles.select("stem").distinct().withColumn("_found", F.lit(True))
    return (
        proteins.withColumn("stem", safe_name(F.col("accession")))
        .join(stems, "stem", "left")
        .withColumn("pssm_available", F.coalesce("_found", F.lit(False)))
        .drop("_found", "stem")
    )
