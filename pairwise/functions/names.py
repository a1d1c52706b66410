"""Feature names by position."""

from pairwise.constants import (
    DESCRIPTORS,
    MAX_LAG,
    PROFILE_LAG_DIM,
    PROFILE_RESIDUES,
    PROFILE_STATISTICS,
    PROPERTY_NAMES,
    RESIDUES,
)


def sequence_names() -> list[str]:
    lags = [f"{prop}_lambda_{i}" for prop in PROPERTY_NAMES for i in range(1, MAX_LAG + 1)]
    return ["Length"] + [f"AA_{residue}" for residue in RESIDUES] + lags


def profile_names(by_lag: bool = False) -> list[str]:
    """``by_lag`` names the last 140 values by lag and residue; valid for 11 positions or more."""
    stats = [f"PSSM_{stat}_{aa}" for stat in PROFILE_STATISTICS for aa in PROFILE_RESIDUES]
    if by_lag:
        width = PROFILE_LAG_DIM // MAX_LAG
        extra = [
            f"PsePSSM_Lag{lag}_{aa}"
            for lag in range(1, MAX_LAG + 1)
            for aa in PROFILE_RESIDUES[:width]
        ]
    else:
        extra = [f"PsePSSM_Extra_{i}" for i in range(1, PROFILE_LAG_DIM + 1)]
    return stats + extra


def compound_names() -> list[str]:
    return [f"Compound_{name}" for name in DESCRIPTORS]
