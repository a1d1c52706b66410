"""Compound features: 64 descriptors in fixed order."""

from pyspark.sql import Column, DataFrame, functions as F

from pairwise.constants import DESCRIPTORS
from pairwise.functions.scalar import above, finite_or_zero
from pairwise.functions.smiles import COUNT_NAMES, with_census

# --- fixed values: descriptors that repeat another one ------------------------------------------
# LipinskiViolations holds the rotatable bond count, not a number of violations.
SAME_AS = {"LipinskiViolations": "RotBonds", "MolLogP": "LogP", "MolMR": "MR"}
# ------------------------------------------------------------------------------------------------


def rule_flags() -> dict[str, Column]:
    """1 if any condition of the rule is broken, else 0."""
    mw, logp, atoms, bonds = (F.col(c) for c in ("MW", "LogP", "AtomCount", "RotBonds"))
    ghose = (
        mw.between(160, 480)
        & logp.between(-0.4, 5.6)
        & atoms.between(20, 70)
        & bonds.between(0, 10)
    )
    ro5 = above("HBD", 5) | above("HBA", 10) | above("MW", 500) | above("LogP", 5)
    veber = above("RotBonds", 10) | above("TPSA", 140)
    return {
        "RO5_Violations": ro5.cast("int"),
        "GhoseViolations": (~ghose).cast("int"),
        "VeberViolations": veber.cast("int"),
    }


def complete_descriptors(table: DataFrame) -> DataFrame:
    """Add what follows from the columns at hand: repeats and rule flags.

    Columns that the table already has stay as they are.
    """
    repeats = {
        n: F.col(source)
        for n, source in SAME_AS.items()
        if n not in table.columns and source in table.columns
    }
    needed = {"MW", "LogP", "HBA", "HBD", "RotBonds", "AtomCount", "TPSA"}
    flags = {}
    if needed <= set(table.columns):
        flags = {n: c for n, c in rule_flags().items() if n not in table.columns}
    return table.withColumns({**repeats, **flags})


def aligned(table: DataFrame) -> list[Column]:
    """The 64 descriptors as doubles in output order; absent, missing and infinite become 0."""
    return [
        (finite_or_zero(F.col(name)) if name in table.columns else F.lit(0.0)).alias(name)
        for name in DESCRIPTORS
    ]


def element_census(table: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the 13 counts of the compound string."""
    counted = with_census(table.select(key, text), text)
    return counted.select(key, *[F.col(name).cast("long").alias(name) for name in COUNT_NAMES])


def one_per_key(descriptors: DataFrame, on: str) -> DataFrame:
    """Of rows with the same key the least one, so the choice does not depend on the partitioning."""
    others = F.struct(*[c for c in descriptors.columns if c != on])
    return descriptors.groupBy(on).agg(F.min(others).alias("_row")).select(on, "_row.*")


def compound_features(compounds: DataFrame, descriptors: DataFrame, on: str = "smile") -> DataFrame:
    """``compound_cid, compound_vector``.

    ``descriptors`` holds graph-based descriptors per ``on``; element counts come from the string
    where the table lacks them.
    """
    missing = [name for name in COUNT_NAMES if name not in descriptors.columns]
    keys = ["compound_cid", *({on} - {"compound_cid"})]
    counted = with_census(compounds, "smile").select(*keys, *missing)
    full = complete_descriptors(counted.join(one_per_key(descriptors, on), on, "left"))
    return full.select("compound_cid", F.array(*aligned(full)).alias("compound_vector"))
