"""The whole run, from staged tables to the feature matrix, as one object.

Every step is a lazy DataFrame. Given a shared ``folder``, the steps in ``keep``
are written there and read back, so later steps start from a table: that cuts
the lineage, is not lost with an executor, and is computed once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from landmarkflow.config import FAMILIES, Config
from landmarkflow.operators import cohort as co
from landmarkflow.operators import concepts as cc
from landmarkflow.operators import exposure, features, qa
from landmarkflow.operators import labels as lb
from landmarkflow.operators import rolling as ro
from landmarkflow.operators.drift import feature_drift, split_prevalence
from landmarkflow.operators.grid import landmarks
from landmarkflow.operators.splits import assign_splits
from landmarkflow.sources.signals import signal_items, signal_map
from landmarkflow.sources.tables import materialize, write_report


# read by several steps
SHARED_STEPS = ("icustays", "measured", "ratio_stages", "onset", "cohort", "landmarks")


class Workflow:
    """``keep`` None writes every step; the default writes those read more than once."""

    def __init__(self, tables, cfg: Config = Config(), folder: str | None = None,
                 keep=SHARED_STEPS):
        self.keep = keep
        self.t = tables
        self.cfg = cfg
        self.folder = folder
        self.spark = tables.icustays.sparkSession

    def _step(self, name: str, df: DataFrame) -> DataFrame:
        written = self.folder and (self.keep is None or name in self.keep)
        return materialize(df, name, self.folder) if written else df

    # --- concepts -----------------------------------------------------------
    @cached_property
    def icustays(self) -> DataFrame:
        return self._step("icustays", self.t.icustays)

    @cached_property
    def weight(self) -> DataFrame:
        return self._step("weight", cc.episode_weight(
            self.icustays, self.t.inputevents, self.t.chartevents, self.cfg.staging))

    @cached_property
    def creatinine(self) -> DataFrame:
        return self._step("creatinine", cc.creatinine(self.t.labevents, self.cfg.staging))

    @cached_property
    def baseline(self) -> DataFrame:
        return self._step("baseline", cc.baseline(self.icustays, self.creatinine,
                                                  self.cfg.staging))

    @cached_property
    def hourly_output(self) -> DataFrame:
        return self._step("hourly_output", cc.signed_hourly_sum(self.t.outputevents))

    @cached_property
    def measured(self) -> DataFrame:
        return self._step("measured", cc.measured(self.icustays, self.creatinine,
                                                  self.cfg.staging))

    @cached_property
    def ratio_stages(self) -> DataFrame:
        return self._step("ratio_stages", cc.staged_by_ratio(self.measured, self.baseline,
                                                             self.cfg.staging))

    @cached_property
    def rate_stages(self) -> DataFrame:
        return self._step("rate_stages", cc.rate_stages(
            self.icustays, self.hourly_output, self.weight, self.cfg.staging))

    @cached_property
    def stages(self) -> DataFrame:
        return self._step("stages", cc.combined_stages(self.rate_stages, self.ratio_stages,
                                                       self.cfg.staging))

    @cached_property
    def onset(self) -> DataFrame:
        return self._step("onset", cc.onset(cc.stage_changes(
            self.icustays, self.hourly_output, self.weight, self.ratio_stages, self.cfg.staging)))

    # --- cohort, landmarks, labels -------------------------------------------
    @cached_property
    def base_cohort(self) -> DataFrame:
        return co.base_cohort(self.icustays, self.t.patients, self.t.admissions,
                              self.cfg.cohort)

    @cached_property
    def cohort(self) -> DataFrame:
        return self._step("cohort", co.cohort(
            self.icustays, self.t.patients, self.t.admissions, self.t.diagnoses_icd,
            self.onset, self.cfg.cohort, self.cfg.landmarks))

    @cached_property
    def landmarks(self) -> DataFrame:
        return self._step("landmarks", co.cohort_landmarks(self.cohort, self.onset,
                                                           self.cfg.landmarks))

    @cached_property
    def stay_landmarks(self) -> DataFrame:
        """Landmarks of every stay, without eligibility or onset rules."""
        return landmarks(self.icustays, self.cfg.landmarks)

    @cached_property
    def labels(self) -> DataFrame:
        return self._step("labels", lb.labels(self.landmarks, self.ratio_stages,
                                              self.cfg.landmarks))

    # --- features -------------------------------------------------------------
    @cached_property
    def numeric_events(self) -> DataFrame:
        return self._step("numeric_events", ro.numeric_events(
            self.t.chartevents, self.t.labevents, self.cohort, signal_map(self.spark),
            {s: signal_items(s) for s in ("chartevents", "labevents")}))

    @cached_property
    def rolling(self) -> DataFrame:
        return self._step("rolling", ro.rolling_features(
            self.landmarks, self.numeric_events, self.cfg.features.windows, self.cfg.landmarks))

    @cached_property
    def treatments(self) -> DataFrame:
        return self._step("treatments", exposure.treatment_block(
            self.landmarks, self.t.inputevents, self.t.chartevents, self.t.outputevents,
            self.cfg.features, self.cfg.landmarks))

    @cached_property
    def matrix(self) -> DataFrame:
        return self._step("matrix", features.feature_matrix(
            self.landmarks, self.cohort, self.numeric_events, self.treatments, self.labels,
            self.cfg))

    @cached_property
    def split_matrix(self) -> DataFrame:
        return assign_splits(self.matrix, self.cfg.evaluation)

    def family(self, name: str) -> DataFrame:
        return features.select_family(self.matrix, FAMILIES[name])

    # --- checks ---------------------------------------------------------------
    def qa_tables(self) -> dict:
        return {"cohort_summary": qa.qa_cohort(self.cohort),
                "landmark_summary": qa.qa_landmarks(self.landmarks),
                "label_prevalence": qa.qa_prevalence(self.labels),
                "leakage_check": qa.qa_leakage(self.rolling),
                "cohort_baseline_coverage": qa.qa_cohort_coverage(self.cohort, self.baseline)}

    def invariants(self) -> DataFrame:
        return qa.invariants(*self.qa_tables().values(), self.cfg)

    def build(self, reports: str | None = None) -> None:
        """Stage every table in run order, then check the invariants and drift."""
        if not self.folder:
            raise ValueError("build needs a shared folder for the written steps")
        for step in ("onset", "cohort", "landmarks", "labels", "numeric_events", "rolling",
                     "treatments", "matrix"):
            getattr(self, step)
        tables = self.qa_tables()
        qa.assert_invariants(*tables.values(), self.cfg)
        if reports:
            combined = assign_splits(self.family("combined"), self.cfg.evaluation, check=True)
            tables["baseline_coverage"] = qa.qa_coverage(self.baseline)
            tables["split_prevalence"] = split_prevalence(combined)
            tables["feature_drift"] = feature_drift(
                combined, features.feature_columns(combined.columns))
            for name, df in tables.items():
                write_report(df, f"{reports}/{name}")
