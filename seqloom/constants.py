"""Public residue tables and the settings results depend on.

All of these must equal the given ones for results to agree; each stands in its natural order under a comment that says
what fixes it.
"""

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AVILMFWYC"
GAP = "-"

# Average residue masses in Da; one water (18.015) leaves per peptide bond.
MASS = {
    "A": 89.09, "C": 121.16, "D": 133.10, "E": 147.13, "F": 165.19,
    "G": 75.07, "H": 155.16, "I": 131.17, "K": 146.19, "L": 131.17,
    "M": 149.21, "N": 132.12, "P": 115.13, "Q": 146.15, "R": 174.20,
    "S": 105.09, "T": 119.12, "V": 117.15, "W": 204.23, "Y": 181.19,
}
WATER = 18.015

# Kyte & Doolittle (1982) hydropathy.
KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8,
    "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5,
    "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
# Eisenberg consensus hydrophobicity.
EISENBERG = {
    "A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19,
    "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06,
    "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53,
    "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26,
}
# a4v aggregation propensity.
AGGREGATION = {
    "A": -0.036, "C": 0.604, "D": -1.836, "E": -1.412, "F": 1.754,
    "G": -0.535, "H": -1.033, "I": 1.822, "K": -0.931, "L": 1.38,
    "M": 0.91, "N": -1.302, "P": -0.334, "Q": -1.231, "R": -1.24,
    "S": -0.294, "T": -0.159, "V": 1.594, "W": 1.037, "Y": 1.159,
}
SCALES = {"kyte_doolittle": KYTE_DOOLITTLE, "eisenberg": EISENBERG, "aggregation": AGGREGATION}

# pK values of Bjellqvist et al. (1993, 1994) as used by public protein toolkits.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERM = 7.5
PK_C_TERM = 3.55
PK_N_TERM_BY_RESIDUE = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_TERM_BY_RESIDUE = {"D": 4.55, "E": 4.75}
# Bisection of the isoelectric point: first guess, bracket, number of halvings to 1e-4.
PI_START, PI_LOW, PI_HIGH, PI_STEPS = 7.775, 4.05, 12.0, 17

# The standard genetic code. Codons per residue in the order of RESIDUES; 61 sense codons.
CODONS = {
    "A": 4, "C": 2, "D": 2, "E": 2, "F": 2, "G": 4, "H": 2, "I": 3, "K": 2, "L": 6,
    "M": 1, "N": 2, "P": 4, "Q": 2, "R": 6, "S": 6, "T": 4, "V": 3, "W": 1, "Y": 2,
}
SENSE_CODONS = 61

# Evidence filters and unit spellings.
ACTIVITY_METRICS = ["MIC", "MBC", "IC50", "EC50"]
COMPARATORS = ["", "=", "~", "<", "<="]
UNITS_UM = ["um", "umol/l", "umolar"]
UNITS_UG_ML = ["ug/ml", "ug/ml.", "ug/ml)", "ug/ml,", "mg/l", "mg/liter"]
SUPERVISED_SUMMARIES = ["positive", "continuous", "mixed"]

# Vocabulary ids after the 20 residues.
TOKEN_UNKNOWN, TOKEN_PAD, TOKEN_MASK = 20, 21, 22

# Column names recognised as sequence and id, in order of preference.
SEQUENCE_COLUMNS = ["variant_sequence", "generated_sequence", "sequence", "peptide", "seq"]
ID_COLUMNS = ["variant_name", "sequence_id", "name", "id"]

# The numbering's widths. Longest allowed region lengths FR1, CDR1, FR2, CDR2, FR3, CDR3, FR4.
REGION_LIMITS = [26, 12, 17, 10, 38, 30, 11]

# Score thresholds of a dual hit.
ACTIVITY_HIT, HEMOLYSIS_HIT = 0.80, 0.40

# The published model thresholds. Nativeness thresholds per model and the common target after rescaling.
NATIVENESS_THRESHOLDS = {"VH": 0.988047, "VKappa": 0.992496, "VLambda": 0.985580, "VHH": 0.990973}
NATIVENESS_TARGET = 0.8


def imgt_positions(last, insertions):
    """IMGT numbering with CDR3 insertions: 111, 111A.., ..112A, 112."""
    letters = [chr(ord("A") + i) for i in range(insertions)]
    return (
        [str(p) for p in range(1, 112)]
        + [f"111{c}" for c in letters]
        + [f"112{c}" for c in reversed(letters)]
        + [str(p) for p in range(112, last + 1)]
    )


HEAVY_POSITIONS = imgt_positions(128, 12)  # width 152
LIGHT_POSITIONS = imgt_positions(127, 6)  # width 139

# Position ranges (first, last) of CDR1, CDR2, CDR3 per numbering scheme and chain.
CDR_RANGES = {
    ("imgt", "H"): [(27, 38), (56, 65), (105, 117)],
    ("imgt", "L"): [(27, 38), (56, 65), (105, 117)],
    ("chothia", "H"): [(26, 33), (52, 55), (95, 101)],
    ("chothia", "L"): [(24, 33), (50, 55), (89, 96)],
    ("aho", "H"): [(27, 42), (57, 69), (108, 138)],
    ("aho", "L"): [(27, 42), (57, 69), (108, 138)],
}

# The numbering's layout. Lengths of the seven regions FR1..FR4 over the fixed slots, codes 0..6.
SEVEN_REGION_LENGTHS = {"H": [26, 12, 17, 10, 39, 37, 11], "L": [26, 12, 17, 10, 39, 25, 10]}

# The slot layout of the variant vectors. Slot ranges (first, last, code), 0-based; other slots are 0. Codes: 1-3 CDR, 4 tail, 5 vernier.
KABAT_VERNIER_SLOTS = {
    "H": [(26, 39, 1), (51, 53, 5), (54, 73, 2), (75, 75, 5), (77, 77, 5), (79, 79, 5),
          (81, 81, 5), (86, 86, 5), (104, 140, 3), (150, 151, 4)],
    "L": [(23, 39, 1), (51, 54, 5), (55, 68, 2), (77, 77, 5), (79, 79, 5), (83, 84, 5),
          (86, 86, 5), (104, 128, 3), (138, 138, 4)],
}
SLOT_COUNT = {"H": 152, "L": 139}
