"""Read-only summaries and bounded previews of workflow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.functions.timefns import hour_boundaries

DEFAULT_ORDER = {"cohort": ("subject_id", "stay_id"),
                 "landmarks": ("subject_id", "stay_id", "landmark_time"),
                 "labels": ("subject_id", "stay_id", "landmark_time")}


def preview(df: DataFrame, n: int = 20, order=None, table: str | None = None) -> DataFrame:
    """First ``n`` rows in the table's usual order (a top-n, no full sort)."""
    order = order or DEFAULT_ORDER.get(table)
    return (df.orderBy(*order) if order else df).limit(int(n))


def landmark_preview(lm: DataFrame, labels: DataFrame, n: int = 20) -> DataFrame:
    """Landmarks with labels and signed hours to the onsets, first ``n`` rows."""
    def to_onset(s):
        return hour_boundaries("landmark_time", f"onset_stage{s}_time").alias(
            f"hours_to_stage{s}_onset")

    ys = ["y_stage1_24h", "y_stage1_48h", "y_stage2_24h", "y_stage2_48h"]
    rows = lm.join(labels.select("stay_id", "landmark_time", *ys), ["stay_id", "landmark_time"],
                   "left")
    return rows.select(
        "subject_id", "stay_id", "anchor_year_group", "age", "sex", "ethnicity", "intime",
        "landmark_time", "hours_since_icu_admit", "onset_stage1_time", "onset_stage2_time",
        to_onset(1), to_onset(2), *ys).orderBy("subject_id", "stay_id", "landmark_time").limit(n)


def landmark_summary(lm: DataFrame) -> DataFrame:
    share = F.when(F.col("onset_stage1_time").isNotNull(), 1).otherwise(0)
    return lm.agg(
        F.count("*").alias("n_landmarks"), F.count_distinct("stay_id").alias("n_stays"),
        F.count_distinct("subject_id").alias("n_patients"),
        F.round(F.avg("hours_since_icu_admit"), 1).alias("mean_hours_since_icu_admit"),
        F.median("hours_since_icu_admit").alias("median_hours_since_icu_admit"),
        F.round(F.avg(share), 4).alias("share_with_stage1_onset_recorded"))


def landmarks_per_episode(lm: DataFrame, k: int = 20) -> DataFrame:
    return (lm.groupBy("stay_id", "subject_id")
            .agg(F.count("*").alias("n_landmarks"),
                 F.min("hours_since_icu_admit").alias("first_landmark_hour"),
                 F.max("hours_since_icu_admit").alias("last_landmark_hour"))
            .orderBy(F.desc("n_landmarks"), "subject_id", "stay_id").limit(k))
