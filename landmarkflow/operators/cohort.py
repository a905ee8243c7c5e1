"""Eligible cohort and its landmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import CohortConfig, LandmarkConfig
from landmarkflow.functions.timefns import hours
from landmarkflow.operators.grid import drop_after_onset, hours_since, landmarks
from landmarkflow.operators.joins import attach_static, exclude


def first_episode(episodes: DataFrame, keys=("subject_id", "hadm_id"), order: str = "intime",
                  tie: str = "stay_id") -> DataFrame:
    """Earliest episode per key: a map-side minimum of whole rows, no sort per group."""
    rest = [c for c in episodes.columns if c not in keys]
    row = F.struct(F.col(order).isNull().alias("_none"), F.col(order).alias("_o"),
                   F.col(tie).alias("_t"), *rest)
    first = episodes.groupBy(*keys).agg(F.min(row).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(
        *episodes.columns)


def eligible(df: DataFrame, cfg: CohortConfig = CohortConfig(), age: str = "anchor_age"
             ) -> DataFrame:
    return df.filter((F.col(age) >= cfg.min_age) & (F.col("los") >= cfg.min_los_hours / 24.0)
                     & (F.col("los") <= cfg.max_los_days))


def diagnosis_match(codes: dict) -> Column:
    """Predicate: the code is listed for its own code-system version."""
    return reduce(lambda a, b: a | b, [
        (F.col("icd_version") == v) & F.col("icd_code").isin(*list(listed))
        for v, listed in codes.items()])


def excluded_patients(diagnoses: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    return diagnoses.filter(diagnosis_match(cfg.excluded_codes)).select("subject_id").distinct()


def prevalent_episodes(episodes: DataFrame, onset: DataFrame, obs_hours: int = 24) -> DataFrame:
    """Stays whose first onset falls on or before the end of the observation window."""
    return (episodes.select("stay_id", "intime").join(onset, "stay_id")
            .filter(F.col("onset_stage1_time") <= F.col("intime") + hours(obs_hours))
            .select("stay_id"))


def age_group(column: str = "age") -> Column:
    age = F.col(column)
    return (F.when(age < 45, "18-44").when(age < 65, "45-64").when(age < 85, "65-84")
            .otherwise("85+"))


def base_cohort(episodes: DataFrame, patients: DataFrame, admissions: DataFrame,
                cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """Eligible episodes with patient and admission columns, before exclusions."""
    first = first_episode(episodes) if cfg.keep_first_stay else episodes
    rows = eligible(attach_static(first, patients, admissions), cfg)
    return rows.select(
        "subject_id", "hadm_id", "stay_id", "first_careunit", "intime", "outtime", "los",
        F.col("gender").alias("sex"), F.col("anchor_age").alias("age"), "anchor_year",
        "anchor_year_group", "dod", "admittime", "dischtime", "deathtime",
        F.col("race").alias("ethnicity"))


def cohort(episodes: DataFrame, patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame,
           onset: DataFrame, cfg: CohortConfig = CohortConfig(),
           lm_cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    base = base_cohort(episodes, patients, admissions, cfg)
    kept = exclude(base, excluded_patients(diagnoses, cfg), "subject_id")
    kept = exclude(kept, prevalent_episodes(base, onset, lm_cfg.obs_hours), "stay_id")
    return kept.withColumn("age_group", age_group())


STATIC = ("stay_id", "subject_id", "hadm_id", "anchor_year_group", "age", "age_group", "sex",
          "ethnicity", "intime", "outtime")


def cohort_landmarks(members: DataFrame, onset: DataFrame,
                     cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Prediction times of the cohort with inherited columns and onset times."""
    times = [f"onset_stage{n}_time" for n in (1, 2, 3)]
    grid = landmarks(members.select(*STATIC).join(onset.select("stay_id", *times), "stay_id",
                                                  "left"), cfg)
    kept = drop_after_onset(grid, "onset_stage1_time", cfg.exclude_after_onset)
    return kept.withColumn("hours_since_icu_admit", hours_since("intime", "landmark_time"))
