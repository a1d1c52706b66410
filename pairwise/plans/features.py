"""Feature run: interactions in, ordered feature tables out."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwise.operators.assemble import assemble, protein_features
from pairwise.operators.compounds import compound_features
from pairwise.operators.entities import unique_compounds, unique_proteins
from pairwise.operators.profiles import profile_features
from pairwise.operators.sequences import sequence_features
from pairwise.session import owned_staging, stage
from pairwise.sinks import files, tables
from pairwise.sources.descriptors import read_descriptors
from pairwise.sources.interactions import read_interactions
from pairwise.sources.listing import find_folders
from pairwise.sources.profiles import attach_profiles, profile_texts
from pairwise.sources.store import extend_store


def feature_table(
    rows: DataFrame,
    profile_rows: DataFrame,
    descriptors: DataFrame,
    on: str = "smile",
    flagged: bool = False,
) -> DataFrame:
    """Rows with their three vectors, everything lazy.

    ``profile_rows`` are ``accession, pos, scores``. Features are computed once per distinct
    protein and compound and joined back. ``flagged`` adds the two first-occurrence flags.
    """
    proteins = protein_features(
        sequence_features(unique_proteins(rows)), profile_features(profile_rows)
    )
    compounds = compound_features(unique_compounds(rows), descriptors, on)
    return assemble(rows, proteins, compounds, flagged)


def run_features(
    spark: SparkSession,
    interactions: str,
    profiles: str,
    descriptors: str,
    store: str,
    output: str,
    flagged: bool = False,
    multi_line: bool = False,
    resume: bool = True,
    rows_per_file: int = files.ROWS_PER_FILE,
) -> None:
    """Read, deduplicate, compute what the store lacks, assemble in order, write, check what was written.

    The numbered rows are staged once because the entity passes, the checks and the assembly all
    read them. The wide assembled rows are not: joining again costs less than storing them. A run
    that stops is repeated with the same store and computes only the missing entities; ``resume``
    False refuses a store that holds any. The run fails if the output is not in input order.
    """
    with owned_staging(spark):
        rows = stage(read_interactions(spark, interactions, multi_line), "interactions")
        n = rows.count()
        if not tables.order_is_intact(rows):
            raise ValueError("row numbers are not 1..n: output would not follow the input order")
        texts = profile_texts(spark, profiles)
        table = read_descriptors(spark, descriptors)

        def protein_vectors(todo: DataFrame) -> DataFrame:
            found = profile_features(attach_profiles(todo, texts))
            return protein_features(sequence_features(todo), found)

        if not resume and find_folders(spark, f"{store}/*"):
            raise FileExistsError(f"{store} holds features of another run")
        proteins = extend_store(
            unique_proteins(rows, staged=True), f"{store}/proteins", "accession", protein_vectors
        )
        compounds = extend_store(
            unique_compounds(rows, staged=True),
            f"{store}/compounds",
            "compound_cid",
            lambda todo: compound_features(todo, table),
        )
        assembled = assemble(rows, proteins, compounds, flagged)
        files.write_matrices(assembled, output, flagged, n, rows_per_file)
        placed = stage(files.written_rows(spark, output, flagged), "written")
        if not tables.order_passed(placed, n):
            raise ValueError(f"the rows in {output}/detailed_features do not follow the input order")
        files.write_order(placed, output, n)
        marked = rows.join(proteins.select("accession", "pssm_available"), "accession", "left")
        stats = tables.processing_stats(marked.fillna(False, ["pssm_available"])).withColumns(
            {
                "order_verification_passed": F.lit(True),
                "preserve_order": F.lit(True),
                "resume_mode": F.lit(resume),
            }
        )
        origin = {"input_file": str(interactions)}
        files.write_json(files.with_run(stats, **origin), f"{output}/processing_stats")
        files.write_json(tables.feature_names(spark, flagged), f"{output}/feature_dictionary")
        settings = files.with_run(tables.feature_settings(spark), **origin)
        files.write_json(settings, f"{output}/feature_settings")
