"""Parameters of one analysis: level lists, thresholds, patterns.

The defaults are the published values of the analysis this library covers.
`TABLES_STUDY` holds the values used on the star-schema test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: must equal the published analysis for equal results ---
CELL_LEVELS = ["Ast", "Exc", "Inh", "Mic", "Oli", "OPC", "Vas", "T_cells"]
SEX_LEVELS = ["female", "male"]
PATHOLOGIES = [
    "amyloid", "gpath", "nft", "tangles", "plaq_d", "plaq_n",
    "cogn_global_lv", "cognep_demog_slope", "cogng_demog_slope",
    "cognpo_demog_slope", "cognps_demog_slope", "cognse_demog_slope",
    "cognwo_demog_slope", "CR_score",
]
SET_TERMS = [
    "GO:0005739", "GO:0005743", "GO:0005741", "GO:0005759",
    "GO:0005758", "GO:0070469", "GO:0005740",
]
SET_PREFIX = r"^MT[-\.]"
QC_COLUMNS = ["pct_counts_mt", "total_counts", "doublet_score"]
SCORE_COLUMN_PATTERN = (
    "(MOOTHA|REACTOME_|KEGG_|HALLMARK_OXIDATIVE_PHOSPHORYLATION|WP_"
    "|GO(BP|CC|MF)_|GALLUZZI_|WONG_|BIOCARTA_)"
)
KEYWORDS = (
    "(OXPHOS|OXIDATIVE|TCA|CITRIC|FATTY[_ ]?ACID|RESPIRATORY|MITOPHAGY"
    "|TRANSLATION|BIOGENESIS)"
)
DRIVER_KEYWORDS = (
    "(MITOPHAGY|FUSION|ATP|ELECTRON TRANSPORT|RNA 3 END|RNA DEGRADATION"
    "|PROTON MOTIVE FORCE)"
)
LABEL_PREFIX = "^(REACTOME|GOBP|GO|WP)_"
RECURRENCE_LIMITS = {
    "Inh": 25, "Exc": 15, "Oli": 20, "Ast": 15,
    "Mic": 12, "OPC": 10, "Vas": 10, "T_cells": 10,
}
FOCUS_CELLS = ["Ast", "Oli", "Vas"]
# --- end of fixed values ---


@dataclass(frozen=True)
class Study:
    cell_levels: list[str] = field(default_factory=lambda: CELL_LEVELS)
    sex_levels: list[str] = field(default_factory=lambda: SEX_LEVELS)
    pathologies: list[str] = field(default_factory=lambda: PATHOLOGIES)
    terms: list[str] = field(default_factory=lambda: SET_TERMS)
    prefix: str = SET_PREFIX
    alpha: float = 0.05
    lfc_min: float = 0.2
    matrix_path: str = "gpath"
    matrix_rows: int = 150
    matrix_cap: float = 2.0
    bubble_cap: float = 0.8
    min_recur: int = 2
    recur_top: int = 20
    recur_limits: dict[str, int] = field(default_factory=lambda: RECURRENCE_LIMITS)
    phenotypes: list[str] = field(default_factory=lambda: PATHOLOGIES)
    qc_columns: list[str] = field(default_factory=lambda: QC_COLUMNS)
    covariate: str = "pct_counts_mt"
    score_pattern: str = SCORE_COLUMN_PATTERN
    keywords: str = KEYWORDS
    driver_keywords: str = DRIVER_KEYWORDS
    focus_cells: list[str] = field(default_factory=lambda: FOCUS_CELLS)
    # cells of one donor, type and sex at most, where that is known: saves a counting pass
    max_cells_per_donor: int | None = None
    min_n: int = 30
    top_strength: float = 1.3
    top_n: int = 25
    contrast_n: int = 30
    interaction_threshold: float = 1.2
    drivers_k: int = 5
    drivers_min_n: int = 3
    drivers_n: int = 15
    drivers_label_n: int = 10


DEFAULT_STUDY = Study()

# Values for the star-schema test tables. One market segment (MACHINERY) is
# left out of the level list on purpose, and one level is never seen, so that
# the closed-level rules are exercised; thresholds suit the value ranges there.
TABLES_STUDY = Study(
    cell_levels=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "UNSEEN"],
    pathologies=["prio_1", "prio_2", "prio_3", "prio_4", "prio_5"],
    terms=["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7"],
    prefix="^19",
    alpha=0.25,
    lfc_min=0.04,
    matrix_path="prio_1",
    bubble_cap=0.05,
    matrix_cap=0.08,
    recur_limits={"AUTOMOBILE": 25, "BUILDING": 15, "FURNITURE": 12, "HOUSEHOLD": 10},
    phenotypes=["prio_1", "prio_2", "prio_3", "prio_4", "prio_5", "acctbal", "absent"],
    keywords="(PRICE|MITOPHAGY|order[_ ]?share)",
    driver_keywords="(PRICE|DISCOUNT|SHARE)",
    focus_cells=["AUTOMOBILE", "BUILDING", "FURNITURE"],
    max_cells_per_donor=10_000,
    top_strength=0.02,
    interaction_threshold=0.05,
)
