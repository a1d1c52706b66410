"""Names, tables and limits that output files and feature values depend on."""

# --- fixed values -----------------------------------------------------------

# Accepted header names per logical field; the first one present is used.
COLUMN_ALIASES = {
    "accession": ["Protein_Accession", "ProteinAccession", "Accession", "Protein_ID", "ProteinID"],
    "sequence": ["Sequence", "Protein_Sequence", "ProteinSequence", "Seq"],
    "compound_cid": ["Compound_CID", "CompoundCID", "CID", "Compound_ID", "CompoundID"],
    "smile": ["Smile", "SMILES", "Canonical_SMILES", "CanonicalSMILES"],
    "label": ["label", "Label", "Class", "Target", "Y"],
}
REQUIRED_FIELDS = ["accession", "sequence", "compound_cid", "smile"]

# Residue -> (hydrophobicity, isoelectric point, molecular weight).
RESIDUE_PROPERTIES = {
    "A": (1.8, 6.0, 89.1),
    "C": (2.5, 5.1, 121.0),
    "D": (-3.5, 3.0, 133.1),
    "E": (-3.5, 4.2, 147.1),
    "F": (2.8, 5.5, 165.2),
    "G": (-0.4, 6.0, 75.1),
    "H": (-3.2, 7.6, 155.2),
    "I": (4.5, 6.0, 131.2),
    "K": (-3.9, 9.7, 146.2),
    "L": (3.8, 6.0, 131.2),
    "M": (1.9, 5.7, 149.2),
    "N": (-3.5, 5.4, 132.1),
    "P": (-1.6, 6.3, 115.1),
    "Q": (-3.5, 5.7, 146.1),
    "R": (-4.5, 10.8, 174.2),
    "S": (-0.8, 5.7, 105.1),
    "T": (-0.7, 5.6, 119.1),
    "V": (4.2, 6.0, 117.1),
    "W": (-0.9, 5.9, 204.2),
    "Y": (-1.3, 5.7, 181.2),
}
PROPERTY_NAMES = ["Hydrophobicity", "Isoelectric_Point", "Molecular_Weight"]

# Column order and statistics of a profile.
PROFILE_RESIDUES = "ARNDCQEGHILKMFPSTWYV"
PROFILE_STATISTICS = ["Mean", "Std", "Max", "Min"]

# The 64 compound descriptors, in output order.
DESCRIPTORS = [
    "MW", "ExactMW", "LogP", "HBA", "HBD", "RotBonds", "AromaticRings",
    "RingCount", "HeteroRings", "SaturatedRings", "AliphaticRings",
    "HeavyAtomCount", "AtomCount", "TPSA", "LabuteASA", "MolSurfaceArea",
    "BertzCT", "Chi0v", "Chi1v", "Kappa1", "Kappa2", "Kappa3",
    "LipinskiViolations", "QED", "RO5_Violations", "GhoseViolations",
    "VeberViolations", "CarbonCount", "NitrogenCount", "OxygenCount",
    "SulfurCount", "PhosphorusCount", "FluorineCount", "ChlorineCount",
    "BromineCount", "IodineCount", "HalogenCount", "FractionCSP3",
    "PEOE_VSA1", "PEOE_VSA2", "PEOE_VSA3", "SMR_VSA1", "SMR_VSA2",
    "SlogP_VSA1", "SlogP_VSA2", "MR", "NHOH_Count", "NO_Count",
    "HallKierAlpha", "ValenceElectrons", "MolLogP", "MolMR",
    "BCUT2D_MWHI", "BCUT2D_MWLOW", "BCUT2D_CHGHI", "BCUT2D_CHGLO",
    "SP3_N_Count", "SP2_N_Count", "Amide_Count", "Ester_Count",
    "Carboxylic_Count", "Ether_Count", "Alcohol_Count", "Amine_Count",
]

# Descriptor groups listed in the feature dictionary.
DESCRIPTOR_GROUPS = {
    "basic_properties": [
        "MW", "ExactMW", "LogP", "HBA", "HBD", "RotBonds", "AromaticRings", "RingCount",
    ],
    "topological_properties": ["TPSA", "LabuteASA", "BertzCT", "Chi0v", "Chi1v"],
    "drug_likeness": [
        "LipinskiViolations", "QED", "RO5_Violations", "GhoseViolations", "VeberViolations",
    ],
    "atom_composition": ["CarbonCount", "NitrogenCount", "OxygenCount", "HalogenCount"],
    "functional_groups": [
        "Amide_Count", "Ester_Count", "Carboxylic_Count", "Ether_Count", "Alcohol_Count",
    ],
}

# Labels written into the detailed export.
POSITIVE_LABEL = "相互作用"
NEGATIVE_LABEL = "无相互作用"

# Consensus strategies, in report order.
STRATEGIES = [
    "all_positive", "majority_positive", "high_confidence", "high_probability", "custom_consensus",
]

# Quick parameter settings: name -> (probability threshold, confidence threshold).
PRESETS = {"strict": (0.8, 0.9), "medium": (0.6, 0.7), "loose": (0.5, 0.6)}

# Vector sizes.
MAX_LAG = 10
SEQUENCE_DIM = 51
PROFILE_DIM = 220
PROFILE_STATS_DIM = 80

# Characters removed at both ends of a text field: the Unicode white space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- derived ----------------------------------------------------------------

RESIDUES = "".join(sorted(RESIDUE_PROPERTIES))
DESCRIPTOR_DIM = len(DESCRIPTORS)
PROFILE_LAG_DIM = PROFILE_DIM - PROFILE_STATS_DIM
