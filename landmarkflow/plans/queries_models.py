"""Queries on model fitting, score sheets, contributions and case selection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from landmarkflow.config import FAMILIES, FAMILIES_TO_TRAIN, TASKS, ModelConfig
from landmarkflow.evaluation.report import full_report
from landmarkflow.explain import cases, importance, sheets
from landmarkflow.explain.contributions import (
    binned_contributions,
    binned_levels,
    contributions,
    linear_contributions,
    linear_terms,
    term_overlap,
)
from landmarkflow.models import design, scorecard
from landmarkflow.models.additive import AdditiveParams, fit_additive
from landmarkflow.models.base import calibrate
from landmarkflow.models.boosted import fit_gbt
from landmarkflow.models.train import MODELS, fit_model, predict_all, train_all
from landmarkflow.models.tune import SearchParams, search
from landmarkflow.operators.features import family_columns
from landmarkflow.operators.splits import group_kfold
from landmarkflow.plans.registry import query
from landmarkflow.sources.tables import materialize, run_folder

FEATURES = ["quantity", "price", "discount", "tax", "flag"]
EDGES = {"quantity": [10.0, 25.0, 40.0], "price": [20.0, 50.0, 75.5],
         "discount": [0.02, 0.05, 0.08], "tax": [0.02, 0.05]}
#: Settings of the queries that need many fits, or a fit only to read something off it.
SMALL = replace(ModelConfig(), c_grid=(0.01, 0.1), folds=2, trees=12, tree_leaves=8, max_iter=25,
                additive_max_bins=6, additive_pairs=2, additive_pair_bins=3, additive_bags=2,
                additive_rounds=300)


def rows(c, split=None):
    """Line items as training rows: five inputs, one with gaps, and a noisy rule as label."""
    hit = (F.col("l_quantity") * F.col("l_discount") > 1.2) != (F.col("l_orderkey") % 11 == 0)
    out = c.fx.scored.select(
        F.col("l_orderkey").alias("stay_id"), "subject_id", "l_linenumber", "split",
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000.0).alias("price"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_linenumber") % 6 != 0, F.col("l_tax")).alias("tax"),
        (F.col("l_linestatus") == "F").cast("double").alias("flag"), hit.cast("int").alias("y"))
    return out.filter(F.col("split") == split) if split else out


def stored(c, split=None):
    """:func:`rows`, written once per query: a fit goes through its rows many times, and would
    join line items and orders again each time."""
    if "_stored" not in vars(c):
        c._stored = materialize(rows(c), "model_rows", run_folder(c.spark))
    return c._stored.filter(F.col("split") == split) if split else c._stored


def profiled_terms(c):
    """Term table of a linear card: profiles and moments from the data, given coefficients."""
    train = rows(c, "train")
    profiles = design.feature_profiles(train, FEATURES)
    medians = {f: p["impute_median"] for f, p in design.collect_profiles(profiles).items()}
    moments = design.long_form(design.imputed(train, medians), FEATURES).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    coef = {"quantity": 0.8, "price": -0.5, "discount": 0.25, "tax": 0.1, "flag": -0.3}
    given = F.create_map(*[x for k, v in coef.items() for x in (F.lit(k), F.lit(v))])
    return profiles.join(moments, "feature").withColumn("coefficient", given[F.col("feature")])


def coded_levels(c):
    """Level table of a binned card with coefficients from the bin number."""
    levels = design.fit_bins(rows(c, "train"), FEATURES, EDGES, "y")
    coef = F.when(F.col("reference"), 0.0).otherwise(F.col("bin_index") * 0.3 - 0.4)
    return levels.withColumn("coefficient", coef)


# --- design -----------------------------------------------------------------------------
@query("m2_select_c", 6)
def _(c):
    li = c.fx.table("lineitem")
    cv = li.groupBy((F.col("l_suppkey") % 9).alias("k")).agg(
        (F.round(F.avg("l_discount"), 4) * 10.0).alias("auroc"),
        F.round(F.avg("l_tax"), 4).alias("brier"),
        F.round(F.avg("l_quantity") / 100.0, 4).alias("auprc"),
        (F.count("*") % 13).cast("double").alias("mean_nonzero"))
    cv = cv.select(((F.col("k") + 1) / 10.0).alias("C"), "auroc", "auprc", "brier", "mean_nonzero")
    return scorecard.select_c(cv, 0.01, 10)


@query("m3_feature_profiles", 9)
def _(c):
    return design.feature_profiles(rows(c, "train"), FEATURES)


@query("m3_fit_bins", 9)
def _(c):
    return design.fit_bins(rows(c, "train"), FEATURES, EDGES, "y")


@query("m3_transform_bins")
def _(c):
    """Sum of each dummy term per split: the design applied to all rows."""
    profiles = design.collect_profiles(design.feature_profiles(rows(c, "train"), FEATURES))
    medians = {f: p["impute_median"] for f, p in profiles.items()}
    terms = design.term_names(FEATURES, EDGES, medians)
    wide = design.transform_bins(rows(c), FEATURES, EDGES, medians)
    sums = wide.groupBy("split").agg(*[F.sum(F.col(t).cast("bigint")).alias(t) for t in terms])
    return sums.unpivot(["split"], terms, "term", "n")


# --- fits ---------------------------------------------------------------------------------
@query("m1_sparse_scorecard", 3)
def _(c):
    cfg = ModelConfig()
    train = group_kfold(stored(c, "train"), "subject_id", cfg.folds)
    model = scorecard.fit_sparse_scorecard(train, FEATURES, "y", cfg.c_grid,
                                           max_iter=cfg.max_iter)
    return linear_terms(c.spark, model).select("feature", "coefficient", "mean", "scale")


@query("m4_binned_scorecard", 3)
def _(c):
    cfg = ModelConfig()
    train = group_kfold(stored(c, "train"), "subject_id", cfg.folds)
    model = scorecard.fit_binned_scorecard(train, FEATURES, EDGES, "y", cfg.c_grid,
                                           max_iter=cfg.max_iter)
    return binned_levels(c.spark, model)


def additive(c, fold=False):
    train = group_kfold(stored(c, "train"), "subject_id", 2) if fold else stored(c, "train")
    return fit_additive(train, FEATURES, "y", AdditiveParams(6, 2, 3, rounds=300),
                        "fold" if fold else None)


@query("m5_additive_model", 3)
def _(c):
    """The configured model: 256 bins, eight bags, ten pairs of a grid of 32 bins."""
    model = fit_model("additive", stored(c, "train"), stored(c, "val"), FEATURES, "y", ModelConfig())
    return full_report(model.score(stored(c, "test")).select("y", "p"), calibration=False)


@query("m6_boosted_trees", 3)
def _(c):
    """The configured trees of 31 leaves, but no more than 25 of them."""
    model = fit_gbt(stored(c, "train"), FEATURES, "y", replace(ModelConfig(), trees=25),
                    stored(c, "val"))
    return full_report(model.score(stored(c, "test")).select("y", "p"), calibration=False)


@query("m7_calibrated", 3)
def _(c):
    """Expected calibration error of balanced trees before and after calibration."""
    from landmarkflow.evaluation.calibration import ece

    model = fit_gbt(stored(c, "train"), FEATURES, "y", SMALL)
    val, test = stored(c, "val"), stored(c, "test")
    out = ece(model.score(test)).select(F.lit("none").alias("method"), "ece")
    for method in ("isotonic", "sigmoid"):
        calibrate(model, val, "y", method)
        out = out.unionByName(ece(model.score(test)).select(F.lit(method).alias("method"), "ece"))
    return out


@query("m8_batch_score", 6)
def _(c):
    model = scorecard.fit_binned_scorecard(stored(c, "train"), FEATURES, EDGES, "y", (1.0,),
                                           max_iter=50)
    return model.score(stored(c, "test")).select("stay_id", "l_linenumber", "quantity", "p")


def trained(c, families=("scorecard_primary_v2",), models=("additive", "scorecard"),
            tasks=("aki_stage1_48h",), cfg=SMALL):
    """Models on the clinical matrix, written first as it is read by every fit."""
    matrix = materialize(c.wf.split_matrix, "split_matrix", c.wf.folder)
    matrices = {f: matrix.select(*family_columns(matrix.columns, FAMILIES[f]), "split")
                for f in families}
    fitted, table = train_all(matrices, tasks, models, cfg)
    return fitted, table, matrices


@query("m9_train_all", 3)
def _(c):
    """Every configured task, family and model, and the short scorecard family, at the
    configured settings."""
    return trained(c, (*FAMILIES_TO_TRAIN, "scorecard_primary_v2"), MODELS, TASKS,
                   ModelConfig())[1]


@query("m10_search", 3)
def _(c):
    """Two random trials of a scorecard, then one proposed from them."""
    return search(stored(c, "train"), FEATURES, "y", "scorecard", 3, 2, SMALL,
                  space=(("C", 1e-3, 1e1, True, False), ("target_features", 2, 5, False, True)),
                  params=SearchParams(startup=2)).drop("pruned")


# --- explanation ------------------------------------------------------------------------------
@query("x1_global_importance", 3)
def _(c):
    return importance.global_importance(c.spark, additive(c))


@query("x2_linear_contributions", 9)
def _(c):
    terms = c.spark.createDataFrame(
        [("quantity", 0.8, 25.0, 25.5, 14.5), ("price", -0.5, 38.0, 40.0, 22.0),
         ("discount", 1.25, 0.05, 0.05, 0.03), ("tax", 0.1, 0.04, 0.04, 0.025)],
        "feature string, coefficient double, impute_median double, mean double, scale double")
    return linear_contributions(rows(c, "test"), terms, FEATURES[:4],
                                ["stay_id", "l_linenumber", "subject_id"])


@query("x2_binned_contributions", 6)
def _(c):
    profiles = design.collect_profiles(design.feature_profiles(rows(c, "train"), FEATURES))
    medians = {f: p["impute_median"] for f, p in profiles.items()}
    return binned_contributions(rows(c, "test"), coded_levels(c), medians,
                                ["stay_id", "l_linenumber"])


@query("x2_additive_contributions", 3)
def _(c):
    model = additive(c)
    return contributions(stored(c, "test"), model, ["stay_id", "l_linenumber"]).groupBy(
        "feature").agg(F.count("*").alias("n"), F.avg(F.abs("contribution_logodds")).alias("size"))


@query("x3_permutation_importance", 3)
def _(c):
    model = fit_gbt(stored(c, "train"), FEATURES, "y", SMALL)
    test = stored(c, "test").withColumn("row_key", F.concat_ws(
        "|", "stay_id", "l_linenumber", "quantity", "price", "discount"))
    return importance.permutation_importance(test, model, "y", None, ("row_key",))


@query("x3_tree_attributions", 3)
def _(c):
    """Mean attributions of boosted trees over the test rows."""
    from landmarkflow.explain.attributions import mean_attributions

    return mean_attributions(stored(c, "test"), fit_gbt(stored(c, "train"), FEATURES, "y", SMALL))


@query("x4_linear_sheet", 6)
def _(c):
    return sheets.linear_sheet(profiled_terms(c), 0.1)


@query("x4_linear_points", 6)
def _(c):
    return sheets.linear_points(profiled_terms(c))


@query("x5_binned_sheet", 6)
def _(c):
    return sheets.binned_sheet(coded_levels(c))


@query("x6_sheet_summary", 6)
def _(c):
    return sheets.sheet_summary(sheets.binned_sheet(coded_levels(c)), 0.3)


@query("x7_term_shapes", 3)
def _(c):
    return importance.term_shapes(c.spark, additive(c, fold=True))


def event_contributions(c, step: int):
    """Contributions of six clinical terms per event, by an arithmetic rule."""
    names = cases.PRIORITY + cases.CONTEXT
    items = F.array(*[F.struct(
        F.lit(n).alias("feature"),
        (((F.col("event_id") * step + j * 13) % 5 - 2) * 0.1).alias("contribution_logodds"))
        for j, n in enumerate(names)])
    keys = c.fx.events.select("stay_id", "subject_id", F.col("ts").alias("landmark_time"),
                              "event_id")
    return keys.select("stay_id", "subject_id", "landmark_time", F.explode(items).alias("_c")
                       ).select("stay_id", "subject_id", "landmark_time", "_c.*")


@query("x8_term_overlap")
def _(c):
    a = event_contributions(c, 3).filter(F.abs("contribution_logodds") > 0.15)
    return term_overlap(a, event_contributions(c, 7), cases.KEYS)


def event_scores(c):
    return c.fx.events.select(
        "stay_id", "subject_id", F.col("ts").alias("landmark_time"),
        F.hour("ts").alias("hours_since_icu_admit"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") / 500.0).alias("p"), (F.col("event_id") % 3).alias("n_missing"),
        ((F.hour("ts") * 60 + F.minute("ts") + 1) / 1500.0).alias("p_reference"))


@query("k5_rank_cases", 6)
def _(c):
    ev = event_scores(c)
    plain = cases.rank_cases(ev.drop("p_reference"), 0.85, None, 10).select(
        F.lit("alone").alias("kind"), "case_rank", "stay_id", "landmark_time", "target_p",
        "distance_to_target", "agreement_gap")
    ref = cases.rank_cases(ev.drop("p_reference"), 0.85,
                           ev.select(*cases.KEYS, "p_reference"), 10)
    return plain.unionByName(ref.select(F.lit("with reference").alias("kind"), *plain.columns[1:]))


@query("k6_rerank_cases", 6)
def _(c):
    ev = event_scores(c)
    shortlist = cases.rank_cases(ev.drop("p_reference"), 0.85,
                                 ev.select(*cases.KEYS, "p_reference"), 200)
    return cases.rerank_cases(shortlist, event_contributions(c, 7), 10).select(
        "case_rank", "stay_id", "landmark_time", "priority_hits", "nonzero_terms", "context_hits",
        "renal_hit", "hemodynamic_hit", "active_terms", "distance_to_target",
        "selection_strategy")


@query("x9_explain_all", 3)
def _(c):
    """Contributions of the reviewed cases from the whole explanation bundle."""
    fitted, _, matrices = trained(c)
    tables = importance.explain_all(c.spark, fitted, matrices)
    out = None
    for (task, family, model), t in tables.items():
        part = t["patient_contributions"].select(
            F.lit(task).alias("task"), F.lit(family).alias("family"), F.lit(model).alias("model"),
            "stay_id", "landmark_time", "feature", "contribution_logodds")
        out = part if out is None else out.unionByName(part)
    return out


@query("c5_full_run", 3)
def _(c):
    """Matrix, training, prediction and evaluation in run order: the test summary."""
    fitted, _, matrices = trained(c)
    predicted = predict_all(fitted, matrices)
    return full_report(predicted, ["task", "family", "model"], calibration=False)
