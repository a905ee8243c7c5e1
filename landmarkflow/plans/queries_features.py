"""Queries on rolling features, exposure, cohort, labels, the matrix, splits and QA."""

from __future__ import annotations

from pyspark.sql import functions as F

from landmarkflow import config as C
from landmarkflow.operators import cohort as co
from landmarkflow.operators import drift, exposure, importance, previews, qa, splits
from landmarkflow.operators import features as ft
from landmarkflow.operators import labels as lb
from landmarkflow.operators import rolling as ro
from landmarkflow.plans.registry import query

LM_KEYS = ("stay_id", "landmark_time")


def flat_importance(c):
    """Correlation-like importances of part attributes per (task, family, model):
    a relation the ranking steps can run on without training anything."""
    li = c.fx.table("lineitem").select(
        F.concat(F.lit("aki_stage"), (F.col("l_linenumber") % 2 + 1).cast("string"),
                 F.when(F.col("l_suppkey") % 2 == 0, "_24h").otherwise("_48h")).alias("task"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 30).cast("string"),
                 F.when(F.col("l_partkey") % 10 == 0, " x f1").otherwise("")).alias("term"),
        (F.col("l_discount") - F.col("l_tax")).alias("d"))
    return (li.groupBy("task", F.lit("combined").alias("family"), F.lit("additive").alias("model"),
                       "term").agg(F.round(F.sum("d") / 100.0, 6).alias("importance")))


# --- rolling ---------------------------------------------------------------------------
@query("a5_rolling_features", 9)
def _(c):
    return ro.rolling_features(c.wf.stay_landmarks, c.all_signals, c.cfg.features.windows,
                               c.cfg.landmarks).drop("landmark_idx")


@query("a5_numeric_events", 9)
def _(c):
    return c.wf.numeric_events


@query("a5_cohort_rolling", 9)
def _(c):
    return c.wf.rolling.drop("landmark_idx")


@query("w4_latest_earliest", 9)
def _(c):
    rows = ro.rolling_features(c.wf.stay_landmarks, c.all_signals, (24,), c.cfg.landmarks)
    return rows.select(*LM_KEYS, "feature_name", "latest_val", "earliest_val", "delta_val")


# --- exposure --------------------------------------------------------------------------
@query("a6_exposure_flags")
def _(c):
    block = exposure.treatment_block(c.wf.stay_landmarks, c.fx.inputevents, c.fx.chartevents,
                                     c.fx.outputevents, c.cfg.features, c.cfg.landmarks)
    return block.select(*LM_KEYS, "vasopressor_any_24h", "loop_diuretic_24h", "mech_vent_24h")


@query("a7_exposure_sums", 6)
def _(c):
    block = exposure.treatment_block(c.wf.stay_landmarks, c.fx.inputevents, c.fx.chartevents,
                                     c.fx.outputevents, c.cfg.features, c.cfg.landmarks)
    return block.select(*LM_KEYS, *[f"fluid_input_ml_{w}h" for w in (6, 12, 24)],
                        *[f"urine_output_ml_{w}h" for w in (6, 12, 24)])


@query("a8_treatment_block", 6)
def _(c):
    return c.wf.treatments.drop("landmark_idx")


# --- cohort and labels --------------------------------------------------------------------
@query("c2_cohort", 6)
def _(c):
    return c.wf.cohort.drop("dod", "deathtime")


@query("c2_cohort_landmarks")
def _(c):
    return c.wf.landmarks.drop("landmark_idx")


@query("c6_prevalent_onset")
def _(c):
    return co.prevalent_episodes(c.wf.base_cohort, c.wf.onset, c.cfg.landmarks.obs_hours)


@query("a9_horizon_labels")
def _(c):
    times = [f"onset_stage{n}_time" for n in (1, 2)]
    lm = c.wf.stay_landmarks.join(c.wf.onset.select("stay_id", *times), "stay_id")
    return lb.horizon_labels(lm).drop("landmark_idx")


@query("a10_event_labels")
def _(c):
    return lb.event_labels(c.wf.stay_landmarks, c.wf.ratio_stages, (24, 48),
                           c.cfg.landmarks).drop("landmark_idx")


@query("c3_labels")
def _(c):
    return c.wf.labels.drop("landmark_idx")


# --- matrix --------------------------------------------------------------------------------
@query("g6_melt", 9)
def _(c):
    return ft.melt_aggs(ro.rolling_features(c.wf.stay_landmarks, c.all_signals, (6, 24),
                                            c.cfg.landmarks))


@query("g7_pivot", 9)
def _(c):
    kinds = ["click", "purchase", "refund"]  # the last one never occurs: schema stays fixed
    wide = ro.rolling_by_window(c.wf.stay_landmarks, ro.fold_signals(c.all_signals, kinds),
                                (6, 24), c.cfg.landmarks)
    lm = c.wf.stay_landmarks.select("stay_id", "landmark_idx", "landmark_time")
    return lm.join(ft.pivot_features(wide, kinds, (6, 24)), ["stay_id", "landmark_idx"]).drop(
        "landmark_idx")


MATRIX_SAMPLE = ("stay_id", "landmark_time", "age", "sex_male", "eth_White", "eth_Black",
                 "eth_Hispanic", "eth_Asian", "eth_Other", "heart_rate_mean_24h",
                 "heart_rate_missing_24h", "map_latest_6h", "map_count_12h", "map_missing_6h",
                 "temperature_c_std_24h", "creatinine_max_24h", "creatinine_delta_24h",
                 "glucose_min_12h", "glucose_missing_12h", "sodium_mean_6h",
                 "sodium_missing_24h", "vasopressor_any_24h", "fluid_input_ml_12h",
                 "urine_output_ml_6h", "y_stage1_24h", "y_stage2_48h", "y_cr_only_stage1_48h")


@query("g8_feature_matrix", 6)
def _(c):
    return c.wf.matrix.select(*MATRIX_SAMPLE)


@query("p13_group_category")
def _(c):
    return c.fx.admissions.select("hadm_id", "race", ft.group_category(
        "race", {k: v for k, v in c.cfg.ethnicity_groups.items() if k != "Other"})
        .alias("ethnicity_group"))


@query("p14_binary_encode")
def _(c):
    return c.fx.patients.select("subject_id", ft.binary_encode("gender", "M").alias("sex_male"))


@query("p15_one_hot")
def _(c):
    rows = c.fx.admissions.select("hadm_id", ft.group_category(
        "race", c.cfg.ethnicity_groups).alias("g"))
    return rows.select("hadm_id", *ft.one_hot("g", c.cfg.ethnicity_groups))


@query("p16_missing_flags")
def _(c):
    wide = ro.rolling_by_window(c.wf.stay_landmarks, c.all_signals, (6, 24), c.cfg.landmarks)
    lm = c.wf.stay_landmarks.select("stay_id", "landmark_idx", "landmark_time")
    full = lm.join(ft.pivot_features(wide, ["click", "view"], (6, 24)),
                   ["stay_id", "landmark_idx"], "left")
    flags = ft.add_missing_flags(full)
    return flags.select(*LM_KEYS, *[f"{k}_{a}_{w}h" for k in ("click", "view")
                                    for a in ("count", "missing") for w in (6, 24)])


@query("p17_feature_family", 6)
def _(c):
    return c.wf.family("scorecard_augmented_v2")


@query("c4_features", 6)
def _(c):
    """The whole feature chain, as the widest bedside family."""
    return c.wf.family("scorecard_augmented")


@query("p18_feature_columns", 6)
def _(c):
    family = c.wf.family("scorecard_core")
    return family.select("stay_id", "landmark_time", *ft.feature_columns(family.columns))


@query("p19_task_labels")
def _(c):
    """Label prevalence keyed by task name, through the name mapping both ways."""
    labels = [C.label_column(t) for t in C.TASKS]
    long = c.wf.labels.unpivot(["stay_id"], labels, "label", "y")
    task = F.create_map(*[F.lit(x) for y in labels for x in (y, C.task_name(y))])[F.col("label")]
    return long.groupBy(task.alias("task")).agg(F.sum("y").alias("n_pos"),
                                                F.count("*").alias("n"))


@query("p20_labelled_rows", 6)
def _(c):
    rows = c.wf.split_matrix.select(
        *C.META_COLUMNS, "split", "creatinine_max_24h",
        F.when(F.col("y_stage1_24h") + F.col("sex_male") < 2, F.col("y_stage1_24h"))
        .alias("y_stage1_24h"))
    return ft.labelled_rows(rows, "y_stage1_24h")


@query("p21_select_results", 6)
def _(c):
    ranked = importance.rank_terms(flat_importance(c))
    return ft.select_results(ranked, tasks=["aki_stage1_24h", "aki_stage2_48h"],
                             families=["combined"])


# --- summaries -------------------------------------------------------------------------------
@query("a11_entity_counts")
def _(c):
    return qa.entity_counts(c.wf.stay_landmarks, n_stays="stay_id", n_patients="subject_id",
                            n_admissions="hadm_id")


@query("a12_landmark_summary", 6)
def _(c):
    return previews.landmark_summary(c.wf.landmarks)


@query("a13_landmarks_per_episode")
def _(c):
    return previews.landmarks_per_episode(c.wf.landmarks, 20)


@query("a14_split_manifest")
def _(c):
    return splits.split_manifest(splits.assign_splits(c.wf.landmarks))


@query("a15_importance_rollup", 6)
def _(c):
    return importance.aggregate_importance(importance.rank_terms(flat_importance(c)))


@query("w6_rank_terms", 6)
def _(c):
    return importance.rank_terms(flat_importance(c))


@query("k1_preview")
def _(c):
    return previews.preview(c.wf.landmarks, 20, table="landmarks").drop("landmark_idx")


@query("k2_landmark_preview")
def _(c):
    return previews.landmark_preview(c.wf.landmarks, c.wf.labels, 20)


@query("k4_minimal_selection", 6)
def _(c):
    rollup = importance.aggregate_importance(importance.rank_terms(flat_importance(c)))
    return importance.selection_table(rollup, 10, "combined")


@query("k4_minimal_family", 6)
def _(c):
    """Matrix cut to the features with the most extreme label-weighted means."""
    matrix = c.wf.matrix
    candidates = ["creatinine_max_24h", "map_mean_12h", "glucose_std_24h",
                  "fluid_input_ml_12h", "urine_output_ml_6h"]
    means = matrix.agg(*[F.avg(F.when(F.col("y_stage1_24h") == 1, F.col(f))).alias(f)
                         for f in candidates])
    scores = means.unpivot([], candidates, "term", "importance").select(
        F.lit("aki_stage1_24h").alias("task"), F.lit("combined").alias("family"),
        F.lit("mean").alias("model"), "term", "importance")
    rollup = importance.aggregate_importance(importance.rank_terms(scores))
    family = ft.minimal_family(matrix, rollup, 3)
    chosen = [f for f in candidates if f in family.columns]
    return family.select("stay_id", "landmark_time", *[F.col(f).cast("double") for f in chosen]
                         ).unpivot(["stay_id", "landmark_time"], chosen, "feature", "value")


# --- QA, splits, drift ------------------------------------------------------------------------
@query("q1_qa_cohort", 6)
def _(c):
    return qa.qa_cohort(c.wf.cohort)


@query("q2_qa_landmarks", 6)
def _(c):
    return qa.qa_landmarks(c.wf.landmarks)


@query("q3_qa_prevalence", 9)
def _(c):
    return qa.qa_prevalence(c.wf.labels)


@query("q4_qa_leakage")
def _(c):
    rolling = ro.rolling_features(c.wf.stay_landmarks, c.all_signals, c.cfg.features.windows,
                                  c.cfg.landmarks)
    return qa.qa_leakage(rolling)


@query("q5_qa_coverage")
def _(c):
    return qa.qa_coverage(c.wf.baseline)


@query("q6_qa_cohort_coverage")
def _(c):
    return qa.qa_cohort_coverage(c.wf.cohort, c.wf.baseline)


@query("q7_invariants", 9)
def _(c):
    return c.wf.invariants()


@query("q8_assign_splits")
def _(c):
    return splits.assign_splits(c.fx.patients).select("subject_id", "anchor_year_group", "split")


@query("q9_exclusive_check")
def _(c):
    """Offending patients of a proper patient split: none."""
    return splits.split_overlap(splits.assign_splits(c.wf.landmarks))


@query("q10_load_split")
def _(c):
    return splits.load_split(splits.assign_splits(c.wf.landmarks), "test").select(
        "stay_id", "subject_id", "landmark_time", "split")


@query("q11_group_kfold")
def _(c):
    rows = c.fx.scored.filter(F.col("split") == "train").select("l_orderkey", "l_linenumber",
                                                                 "subject_id")
    return splits.group_kfold(rows, "subject_id", 5)


@query("u3_split_overlap")
def _(c):
    """Patients spanning splits when rows are split by time alone."""
    return splits.split_overlap(c.fx.scored)


@query("q12_split_prevalence", 9)
def _(c):
    rows = splits.assign_splits(c.wf.labels.join(
        c.wf.cohort.select("stay_id", "anchor_year_group"), "stay_id"))
    out = drift.split_prevalence(rows, list(C.LABEL_COLUMNS))
    return out.toDF(*[n.replace("prev.", "prev_") for n in out.columns])


@query("q13_feature_drift", 6)
def _(c):
    rows = c.fx.scored
    rows = rows.withColumn("sparse", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax"))
                           ).withColumn("empty_in_test", F.when(F.col("split") != "test",
                                                                F.col("l_tax")))
    return drift.feature_drift(rows, ["p", "y", "l_extendedprice", "l_discount", "sparse",
                                      "empty_in_test"])


@query("q13_matrix_drift", 6)
def _(c):
    names = ["age", "creatinine_max_24h", "map_mean_12h", "glucose_std_24h",
             "fluid_input_ml_12h", "urine_output_ml_6h"]
    return drift.feature_drift(c.wf.split_matrix.select("split", *names), names).drop("flagged")
