"""Summaries, the leakage check and the invariant gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import Config
from landmarkflow.functions.timefns import micros

PREVALENCES = {"prev_stage1_24h": "y_stage1_24h", "prev_stage1_48h": "y_stage1_48h",
               "prev_stage2_24h": "y_stage2_24h", "prev_stage2_48h": "y_stage2_48h",
               "prev_cr_only_24h": "y_cr_only_stage1_24h",
               "prev_cr_only_48h": "y_cr_only_stage1_48h"}


def entity_counts(df: DataFrame, **columns) -> DataFrame:
    """Row count plus exact distinct counts, ``name=column``."""
    return df.agg(F.count("*").alias("n_rows"),
                  *[F.count_distinct(c).alias(n) for n, c in columns.items()])


def qa_cohort(members: DataFrame) -> DataFrame:
    return members.agg(
        F.count("*").alias("n_stays"), F.count_distinct("subject_id").alias("n_patients"),
        F.count_distinct("hadm_id").alias("n_admissions"), F.min("age").alias("min_age"),
        F.max("age").alias("max_age"), F.avg("age").alias("mean_age"),
        F.sum(F.when(F.col("sex") == "F", 1).otherwise(0)).alias("n_female"),
        F.min("anchor_year_group").alias("earliest_year_group"),
        F.max("anchor_year_group").alias("latest_year_group"))


def qa_landmarks(lm: DataFrame) -> DataFrame:
    return lm.agg(
        F.count("*").alias("n_landmarks"),
        F.count_distinct("stay_id").alias("n_stays_with_landmarks"),
        F.count_distinct("subject_id").alias("n_patients_with_landmarks"),
        F.avg("hours_since_icu_admit").alias("mean_hours_since_admit"),
        F.max("hours_since_icu_admit").alias("max_hours_since_admit"))


def qa_prevalence(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("*").alias("n_landmarks"),
                      *[F.avg(c).alias(n) for n, c in PREVALENCES.items()])


def qa_leakage(rolling: DataFrame) -> DataFrame:
    """Windowed rows whose newest event is in the future or oldest before the window."""
    start = F.col("landmark_time") - F.make_dt_interval(hours=F.col("window_h"))
    late = F.col("latest_event_time") > F.col("landmark_time")
    early = F.col("earliest_event_time") <= start
    ahead = micros("latest_event_time") - micros("landmark_time")
    return rolling.agg(
        F.count("*").alias("n_rolling_rows"),
        F.sum(F.when(late, 1).otherwise(0)).alias("n_future_feature_rows"),
        F.sum(F.when(early, 1).otherwise(0)).alias("n_before_window_feature_rows"),
        F.max(ahead).alias("max_future_offset_us"))


def qa_coverage(base: DataFrame) -> DataFrame:
    def known(c):
        return F.sum(F.when(F.col(c).isNotNull(), 1))

    return base.agg(F.count("*").alias("n_stays"), known("baseline_mg_dl").alias("n_with_baseline"),
                    known("baseline_7d").alias("n_7d_baseline"),
                    known("baseline_365d").alias("n_365d_baseline"))


def qa_cohort_coverage(members: DataFrame, base: DataFrame) -> DataFrame:
    cols = ("stay_id", "baseline_mg_dl", "baseline_7d", "baseline_365d")
    return qa_coverage(members.select("stay_id").join(base.select(*cols), "stay_id", "left"))


def invariants(cohort: DataFrame, lm: DataFrame, prevalence: DataFrame, leakage: DataFrame,
               coverage: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All rules as ``(rule, value, ok)`` from the five one-row summaries.

    A missing number fails its rule, and an empty rolling table does too: no
    rows is no proof that nothing leaks.
    """
    parts = {"c": cohort, "l": lm, "y": prevalence, "k": leakage, "b": coverage}
    one = cohort.sparkSession.range(1).select(*[
        df.select(F.struct(*df.columns)).scalar().alias(p) for p, df in parts.items()])

    def v(name):
        part, column = name.split("_", 1)
        return F.col(f"{part}.{column}").cast("double")

    rules = [("cohort is not empty", v("c_n_stays"), v("c_n_stays") > 0),
             ("cohort has patients", v("c_n_patients"), v("c_n_patients") > 0),
             ("minimum age holds", v("c_min_age"), v("c_min_age") >= cfg.cohort.min_age),
             ("landmarks are not empty", v("l_n_landmarks"), v("l_n_landmarks") > 0),
             ("stays have landmarks", v("l_n_stays_with_landmarks"),
              v("l_n_stays_with_landmarks") > 0),
             ("labels are not empty", v("y_n_landmarks"), v("y_n_landmarks") > 0)]
    for p in PREVALENCES:
        rules.append((f"{p} within [0, 1]", v(f"y_{p}"), v(f"y_{p}").between(0.0, 1.0)))
    for s in (1, 2):
        gain = v(f"y_prev_stage{s}_48h") - v(f"y_prev_stage{s}_24h")
        rules.append((f"stage{s} 48h prevalence is at least 24h", gain, gain >= 0))
    for h in (24, 48):
        gap = v(f"y_prev_stage1_{h}h") - v(f"y_prev_stage2_{h}h")
        rules.append((f"stage2 {h}h prevalence is at most stage1", gap, gap >= 0))
    rules += [("rolling features are not empty", v("k_n_rolling_rows"),
               v("k_n_rolling_rows") > 0),
              ("no events after landmark_time", v("k_n_future_feature_rows"),
               v("k_n_future_feature_rows") == 0),
              ("no events before the window", v("k_n_before_window_feature_rows"),
               v("k_n_before_window_feature_rows") == 0),
              ("baseline rows match the cohort", v("b_n_stays") - v("c_n_stays"),
               v("b_n_stays") == v("c_n_stays"))]
    table = F.array(*[F.struct(F.lit(n).alias("rule"), x.alias("value"),
                               F.coalesce(ok, F.lit(False)).alias("ok")) for n, x, ok in rules])
    return one.select(F.explode(table).alias("_r")).select("_r.*")


def assert_invariants(cohort, lm, prevalence, leakage, coverage, cfg: Config = Config()) -> None:
    """Raise once, naming every broken rule."""
    broken = [f"{r['rule']} (value {r['value']})" for r in
              invariants(cohort, lm, prevalence, leakage, coverage, cfg).collect() if not r["ok"]]
    if broken:
        raise AssertionError("QA invariant failure(s): " + "; ".join(broken))
