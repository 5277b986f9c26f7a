"""Parameters of the analysis; every operator takes its thresholds from here."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the plant data: result labels, stages in order with their replay ranks, and batch kinds with theirs.
GOOD, DEFECT = "양품", "불량"
STAGES = (
    ("CAST_RECORDED", 0), ("FURNACE_CHARGED", 10), ("PREHEAT_COMPLETE", 11), ("HEAT_COMPLETE", 12), ("SOAK_COMPLETE", 13),
    ("FURNACE_EXTRACTED", 14), ("RM4_RECORDED", 15), ("AP_RECORDED_WITH_RESULT", 20),
)
BATCH_KINDS = (("CAST_DAY", 0), ("FURNACE_HOUR", 1), ("AP_DAY", 2))


@dataclass(frozen=True)
class AnalysisConfig:
    reference_fraction: float = 0.7
    discovery_fraction: float = 0.7
    maturity_days: int = 38
    range_support: int = 400
    tail_support: int = 2000
    numeric_bins: int = 10
    interaction_bins: int = 3
    discovery_support: int = 200
    confirmation_support: int = 100
    informative_strata: int = 2
    caution_defects: int = 5
    danger_defects: int = 10
    confirmation_defects: int = 5
    rr_caution: float = 1.5
    rr_danger: float = 2.0
    rd_caution: float = 0.005
    rd_danger: float = 0.01
    q_caution: float = 0.10
    q_danger: float = 0.05
    confirm_rr_danger: float = 1.5
    bootstrap_replicates: int = 2000
    bootstrap_valid: int = 1900
    wilson_z: float = 1.959963984540054


@dataclass(frozen=True)
class Feature:
    """A monitored field: its stage and date, whose equipment it belongs to, and whether it is numeric."""

    name: str
    stage: str
    date: str
    equipment_type: str
    equipment: str
    numeric: bool = True
    role: str = "DIRECT_OPERATION"


#: Fields of the bound tables that ranges and rules look at.
FEATURES = (
    Feature("tundish_temp", "CAST_RECORDED", "cast_date", "SM_CC", "steel_grade"),
    Feature("f_heat_temp", "HEAT_COMPLETE", "f_ext_date", "FURNACE", "furnace_no"),
    Feature("f_bfg_ratio", "HEAT_COMPLETE", "f_ext_date", "FURNACE", "furnace_no"),
    Feature("f_cog_ratio", "HEAT_COMPLETE", "f_ext_date", "FURNACE", "furnace_no"),
)
CATEGORIES = ("steel_grade", "steel_usage", "furnace_no", "f_jangip_gubun")
INTERACTIONS = (("tundish_temp", "f_heat_temp"), ("f_heat_temp", "f_bfg_ratio"))
#: Context hierarchy of ranges, most specific first, and of the rules' adjustment.
CONTEXTS = (("steel_grade", "steel_usage"), ("steel_grade",), ())
ADJUSTMENTS = (("steel_grade", "furnace_no"), ("steel_grade",), ())
