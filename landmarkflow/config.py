"""Typed configuration with the published defaults.

Every clinical constant of the workflow is a parameter here, so the operators
stay generic: they run on hospital tables with the defaults and on any other
event data with a changed config.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

# --- fixed values: item identifiers and valid ranges -------------------------
# (feature, item ids, lowest valid value, highest valid value)
VITALS = (
    ("heart_rate", (220045,), 20.0, 300.0),
    ("sbp", (220050, 220179), 40.0, 300.0),
    ("dbp", (220051, 220180), 20.0, 200.0),
    ("map", (220052, 220181), 30.0, 250.0),
    ("resp_rate", (220210,), 4.0, 70.0),
    ("spo2", (220277,), 50.0, 100.0),
    ("temperature_c", (223762,), 30.0, 45.0),
    ("gcs_eye", (220739,), 1.0, 4.0),
    ("gcs_verbal", (223900,), 1.0, 5.0),
    ("gcs_motor", (223901,), 1.0, 6.0),
)
FAHRENHEIT_ITEMS = (223761,)  # folded into temperature_c

LABS = (
    ("creatinine", (50912,), 0.1, 30.0),
    ("bun", (51006,), 1.0, 200.0),
    ("potassium", (50971,), 1.5, 10.0),
    ("sodium", (50983,), 110.0, 170.0),
    ("bicarbonate", (50882,), 5.0, 50.0),
    ("chloride", (50902,), 70.0, 140.0),
    ("glucose", (50931, 50809), 20.0, 1000.0),
    ("hemoglobin", (51222,), 2.0, 25.0),
    ("hematocrit", (51221,), 10.0, 70.0),
    ("wbc", (51301,), 0.1, 100.0),
    ("platelets", (51265,), 5.0, 1500.0),
    ("lactate", (50813,), 0.1, 30.0),
    ("albumin", (50862,), 0.5, 6.0),
    ("ph_arterial", (50820,), 6.5, 8.0),
)
RENAL_LABS = ("creatinine", "bun")

VASOPRESSOR_ITEMS = (221906, 222315, 221289, 221662, 221749, 221653)
LOOP_DIURETIC_ITEMS = (221794,)
MECH_VENT_ITEMS = (225792, 225794)
FLUID_UNITS = ("ml", "mL")
URINE_ITEMS = (226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567,
               226557, 227488, 227489)
IRRIGANT_ITEMS = (227488,)  # volume in, counted negative
WEIGHT_KG_ITEMS = (224639, 226512)
WEIGHT_LB_ITEMS = (226531,)
LB_PER_KG = 2.20462

ETHNICITY_GROUPS = {
    "White": ("WHITE", "WHITE - RUSSIAN", "WHITE - BRAZILIAN", "WHITE - EASTERN EUROPEAN",
              "WHITE - OTHER EUROPEAN", "PORTUGUESE"),
    "Black": ("BLACK/AFRICAN AMERICAN", "BLACK/CAPE VERDEAN", "BLACK/CARIBBEAN ISLAND",
              "BLACK/AFRICAN"),
    "Hispanic": ("HISPANIC OR LATINO", "HISPANIC/LATINO - PUERTO RICAN",
                 "HISPANIC/LATINO - DOMINICAN", "HISPANIC/LATINO - GUATEMALAN",
                 "HISPANIC/LATINO - CUBAN", "HISPANIC/LATINO - SALVADORAN",
                 "HISPANIC/LATINO - CENTRAL AMERICAN", "HISPANIC/LATINO - MEXICAN",
                 "HISPANIC/LATINO - COLOMBIAN", "HISPANIC/LATINO - HONDURAN"),
    "Asian": ("ASIAN", "ASIAN - CHINESE", "ASIAN - SOUTH EAST ASIAN", "ASIAN - ASIAN INDIAN",
              "ASIAN - KOREAN"),
    "Other": ("OTHER", "UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER",
              "AMERICAN INDIAN/ALASKA NATIVE", "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER",
              "SOUTH AMERICAN", "MULTIPLE RACE/ETHNICITY"),
}

# --- fixed values: column roles and feature families -------------------------
AGGREGATIONS = ("latest", "delta", "min", "max", "mean", "std", "count")
LABEL_COLUMNS = ("y_stage1_24h", "y_stage1_48h", "y_stage2_24h", "y_stage2_48h",
                 "y_cr_only_stage1_24h", "y_cr_only_stage1_48h")
META_COLUMNS = ("stay_id", "subject_id", "landmark_time", "anchor_year_group", "age",
                "age_group", "sex", "ethnicity", "hours_since_icu_admit")
NOT_FEATURES = ("stay_id", "subject_id", "landmark_time", "anchor_year_group", "age_group",
                "sex", "ethnicity", "hours_since_icu_admit", "split")
TREATMENT_COLUMNS = ("vasopressor_any_24h", "loop_diuretic_24h", "mech_vent_24h",
                     "fluid_input_ml_6h", "fluid_input_ml_12h", "fluid_input_ml_24h",
                     "urine_output_ml_6h", "urine_output_ml_12h", "urine_output_ml_24h")
RENAL_TREATMENTS = ("urine_output_ml_6h", "urine_output_ml_12h", "urine_output_ml_24h")

BIN_EDGES = {
    "age": (50.0, 65.0, 75.0),
    "urine_output_ml_6h": (200.0, 400.0, 800.0),
    "creatinine_max_24h": (0.8, 1.1, 1.5),
    "map_mean_12h": (65.0, 75.0, 90.0),
    "fluid_input_ml_12h": (500.0, 1500.0, 3000.0),
    "glucose_std_24h": (10.0, 25.0, 50.0),
    "hematocrit_max_24h": (28.0, 33.0, 38.0),
}


@dataclass(frozen=True)
class Family:
    """One feature family: groups to include, or an explicit column list."""

    include: tuple = ()
    exclude_renal: bool = False
    encoded_demographics: bool = True
    selected: tuple = ()
    max_features: int | None = None
    binned: bool = False  # scorecard uses BIN_EDGES on the selected columns


FAMILIES = {
    "vitals_only": Family(("demographics", "vitals")),
    "labs_only": Family(("demographics", "labs")),
    "combined": Family(("demographics", "vitals", "labs", "treatments")),
    "renal_excluded": Family(("demographics", "vitals", "labs", "treatments"),
                             exclude_renal=True),
    "minimal": Family(max_features=10),
    "scorecard_primary": Family(
        encoded_demographics=False, binned=True,
        selected=("age", "urine_output_ml_6h", "creatinine_max_24h", "map_mean_12h",
                  "fluid_input_ml_12h", "glucose_std_24h", "hematocrit_max_24h")),
    "scorecard_core": Family(
        encoded_demographics=False, binned=True,
        selected=("age", "urine_output_ml_6h", "creatinine_max_24h", "map_mean_12h",
                  "hematocrit_max_24h")),
    "scorecard_augmented": Family(
        encoded_demographics=False, binned=True,
        selected=("age", "urine_output_ml_6h", "creatinine_max_24h", "map_mean_12h",
                  "hematocrit_max_24h", "loop_diuretic_24h", "fluid_input_ml_12h",
                  "glucose_std_24h")),
    "scorecard_primary_v2": Family(
        encoded_demographics=False, binned=True,
        selected=("age", "creatinine_max_24h", "map_mean_12h")),
    "scorecard_augmented_v2": Family(
        encoded_demographics=False, binned=True,
        selected=("age", "creatinine_max_24h", "map_mean_12h", "loop_diuretic_24h",
                  "fluid_input_ml_12h", "glucose_std_24h")),
}
FAMILIES_TO_TRAIN = ("vitals_only", "labs_only", "combined", "renal_excluded")
TASKS = ("aki_stage1_24h", "aki_stage1_48h", "aki_stage2_24h", "aki_stage2_48h")

KEY_METRICS = ("auroc", "auprc", "brier", "calibration_slope", "calibration_intercept", "ece",
               "sensitivity_at_spec_90", "specificity_at_sens_90")


# --- fixed values: defaults of the configuration -------------------------------
@dataclass(frozen=True)
class CohortConfig:
    min_age: int = 18
    min_los_hours: int = 30
    max_los_days: int = 30
    keep_first_stay: bool = True
    excluded_codes: dict = field(default_factory=lambda: {10: ("N186",), 9: ("5856",)})


@dataclass(frozen=True)
class LandmarkConfig:
    obs_hours: int = 24
    spacing_hours: int = 6
    min_stay_hours: int = 30
    horizons: tuple = (24, 48)
    exclude_after_onset: bool = True

    @property
    def max_horizon(self) -> int:
        return max(self.horizons)


@dataclass(frozen=True)
class StagingConfig:
    """Thresholds of the two severity ladders."""

    ratio_cuts: tuple = (1.5, 2.0, 3.0)
    abs_rise: float = 0.3
    abs_level: float = 4.0
    rise_hours: int = 48
    fallback_hours: int = 168
    episode_days: int = 30
    creatinine_range: tuple = (0.1, 30.0)
    baseline_days: tuple = (7, 365)
    baseline_gap_minutes: int = 1
    weight_kg_range: tuple = (30.0, 300.0)
    weight_lb_range: tuple = (66.0, 660.0)
    rate_windows: tuple = (6, 12, 24)
    rate_min_observed: tuple = (3, 6, 12)
    anuria_window: int = 12
    anuria_min_observed: int = 12
    low_rate: float = 0.5
    very_low_rate: float = 0.3
    carry_hours: int = 168


@dataclass(frozen=True)
class FeatureConfig:
    windows: tuple = (6, 12, 24)
    exposure_hours: int = 24


@dataclass(frozen=True)
class EvalConfig:
    train_groups: tuple = ("2008 - 2010", "2011 - 2013")
    val_groups: tuple = ("2014 - 2016",)
    test_groups: tuple = ("2017 - 2019", "2020 - 2022")
    calibration_bins: int = 10
    threshold_min: float = 0.01
    threshold_max: float = 0.50
    threshold_step: float = 0.01
    clinical_thresholds: tuple = (0.05, 0.10, 0.20)
    bootstrap_iterations: int = 1000
    confidence: float = 0.95
    sexes: tuple = ("M", "F")
    age_bands: tuple = ((18, 45), (45, 65), (65, 85), (85, 120))
    ethnicities: tuple = ("White", "Black", "Hispanic", "Asian", "Other")
    min_subgroup_n: int = 100
    disparity: float = 0.05
    auroc_tolerance: float = 0.02
    slope_tolerance: float = 0.05
    ece_tolerance: float = 0.02
    net_benefit_tolerance: float = 0.0


@dataclass(frozen=True)
class ModelConfig:
    c_grid: tuple = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
    target_features: int = 10
    selection_tolerance: float = 0.01
    refit_c: float = 1.0
    max_iter: int = 100
    folds: int = 5
    additive_max_bins: int = 256
    additive_pair_bins: int = 32
    additive_pairs: int = 10
    additive_bags: int = 8
    additive_learning_rate: float = 0.01
    additive_rounds: int = 5000
    additive_early_stopping: int = 50
    additive_min_rows: int = 2
    trees: int = 2000
    tree_learning_rate: float = 0.05
    tree_leaves: int = 31
    tree_depth: int = -1
    tree_min_rows: int = 20
    tree_subsample: float = 0.8
    tree_column_share: float = 0.8
    tree_alpha: float = 0.0
    tree_lambda: float = 0.0
    tree_early_stopping: int = 100
    calibration: str = "isotonic"
# --- end of fixed values -------------------------------------------------------


@dataclass(frozen=True)
class Config:
    cohort: CohortConfig = CohortConfig()
    landmarks: LandmarkConfig = LandmarkConfig()
    staging: StagingConfig = StagingConfig()
    features: FeatureConfig = FeatureConfig()
    evaluation: EvalConfig = EvalConfig()
    models: ModelConfig = ModelConfig()
    ethnicity_groups: dict = field(default_factory=lambda: dict(ETHNICITY_GROUPS))
    seed: int = 42

    def fingerprint(self) -> str:
        """16 hex digits of SHA-256 over the sorted JSON form."""
        blob = json.dumps(dataclasses.asdict(self), sort_keys=True, default=str)
        return hashlib.sha256(blob.encode()).hexdigest()[:16]


def feature_names() -> tuple:
    """Names of all windowed features, vitals first."""
    return tuple(v[0] for v in VITALS) + tuple(v[0] for v in LABS)


def label_column(task: str) -> str:
    """``aki_stage1_24h`` -> ``y_stage1_24h``."""
    stage, horizon = task.removeprefix("aki_").rsplit("_", 1)
    return f"y_{stage}_{horizon}"


def task_name(label: str) -> str:
    """``y_stage1_24h`` -> ``aki_stage1_24h``."""
    return "aki_" + label.removeprefix("y_")
