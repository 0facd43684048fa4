"""Names, codes, tables and patterns that results must agree with. Not to be edited for style."""

from __future__ import annotations

# Factors from a unit to s^-1 or M.
RATE_UNITS = {
    "ms^-1": 1000.0, "s^-1": 1.0, "sec^-1": 1.0, "min^-1": 1 / 60, "m^-1": 1 / 60, "hr^-1": 1 / 3600, "h^-1": 1 / 3600,
}
MOLAR_UNITS = {"M": 1.0, "mM": 1e-3, "µM": 1e-6, "μM": 1e-6, "nM": 1e-9, "pM": 1e-12}
# The order in which a unit is looked for anywhere in a text.
UNIT_SEARCH = ["ms^-1", "sec^-1", "s^-1", "min^-1", "m^-1", "hr^-1", "h^-1", "pM", "mM", "µM", "nM", "M"]
# Endings that stand for a rate unit.
PER_ENDINGS = {"s": "s^-1", "sec": "s^-1", "min": "min^-1", "h": "h^-1", "hr": "h^-1"}

# Greek letters (and sharp s) by name.
GREEK = {
    "α": "alpha", "β": "beta", "ß": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta",
    "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
# Characters that become '-'.
DASHES = "-᠆‑‒–—―﹘﹣－˗−‐⁻"
# Quotes, superscripts and marks.
MARKS = {
    "‘": "'", "’": "'", "′": "'", "“": '"', "”": '"', "″": '"',
    "²": "2", "³": "3", "⁺": "+", "(±)-": "", "®": "",
}
# Superscript characters and their plain forms.
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")

# Common organism names.
ORGANISMS = {
    "Human": "Homo sapiens", "human": "Homo sapiens", "H. sapiens": "Homo sapiens", "Mouse": "Mus musculus", "mouse": "Mus musculus",
    "Rat": "Rattus norvegicus", "rat": "Rattus norvegicus", "E. coli": "Escherichia coli", "HIV-1": "Human immunodeficiency virus 1",
    "bovine": "Bos taurus", "Bovine": "Bos taurus", "Porcine": "Sus scrofa", "porcine": "Sus scrofa", "pig": "Sus scrofa", "Pig": "Sus scrofa",
    "chicken": "Gallus gallus", "Chicken": "Gallus gallus", "barley": "Hordeum vulgare", "Barley": "Hordeum vulgare",
    "soybean": "Glycine max", "Soybean": "Glycine max", "wheat": "Triticum aestivum", "Wheat": "Triticum aestivum",
    "maize": "Zea mays", "Maize": "Zea mays", "Corn": "Zea mays", "corn": "Zea mays", "Horse": "Equus caballus", "horse": "Equus caballus",
}
ORGANISM_PARTS = {"SARS-CoV": "Severe acute respiratory syndrome coronavirus"}

# Amino acids by three letters.
AMINO = {
    "Ala": "A", "Cys": "C", "Asp": "D", "Glu": "E", "Phe": "F", "Gly": "G", "His": "H", "Ile": "I", "Lys": "K", "Leu": "L",
    "Met": "M", "Asn": "N", "Pro": "P", "Gln": "Q", "Arg": "R", "Ser": "S", "Thr": "T", "Val": "V", "Trp": "W", "Tyr": "Y",
}

# Accession patterns.
PDB = r"(?i)\b[1-9][A-Z0-9]{3}\b"
UNIPROT = r"(?i)[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}"
NOT_UNIPROT = ["K2HPO4", "C8H9O2", "H2S2O3"]
REFSEQ = r"\b((?:A[CP]|N[CGTWZMRP]|X[MRP]|YP|WP)_\d+(?:\.\d+)?)\b"
GENBANK = r"(?i)\b([A-Z]{1,3}\d{5,8}(?:\.\d+)?)\b"

# Spellings of the unmutated form.
WILD_TYPES = ["wt", "wildtype", "wild type", "wild-type"]
