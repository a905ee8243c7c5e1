"""Global importances per model kind, shape tables and the explanation bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import label_column
from landmarkflow.evaluation.curves import auroc
from landmarkflow.explain import cases, sheets
from landmarkflow.explain.attributions import mean_attributions
from landmarkflow.explain.contributions import (
    binned_levels,
    contributions,
    linear_terms,
    term_overlap,
)
from landmarkflow.models.additive import shape_frame
from landmarkflow.models.base import FittedModel
from landmarkflow.operators.features import select_results
from landmarkflow.operators.splits import load_split, rank_in_order
from landmarkflow.sources.tables import materialize, run_folder


def global_importance(spark, model: FittedModel) -> DataFrame:
    """``(term, importance)``: mean |score| over training mass, |coefficient|, or gain."""
    if model.name == "additive":
        s = shape_frame(spark, model)
        return s.groupBy("term").agg((F.sum(F.abs("score") * F.col("mass")) / F.sum("mass"))
                                     .alias("importance"))
    if model.name == "scorecard":
        if model.extra["representation"] == "binned":
            return binned_levels(spark, model).filter(~F.col("reference")).select(
                F.concat_ws(": ", "feature", "range_display").alias("term"),
                F.abs("coefficient").alias("importance"))
        return linear_terms(spark, model).select(
            F.col("feature").alias("term"), F.abs("coefficient").alias("importance"))
    return spark.createDataFrame(list(model.extra["importance"].items()),
                                 "term string, importance double")


def term_shapes(spark, model: FittedModel) -> DataFrame:
    """Score and bounds per (term, bin), with the bin's value range for single terms."""
    rows = []
    for f in model.features:
        cuts = [None, *model.extra["edges"][f], None]
        rows += [(f, i, cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)]
    ranges = spark.createDataFrame(rows, "term string, bin_a int, value_from double, "
                                         "value_to double")
    return shape_frame(spark, model).join(ranges, ["term", "bin_a"], "left")


def shuffled(df: DataFrame, features, keys, seed: int = 42, out=None) -> DataFrame:
    """``df`` with columns randomly permuted over all rows, all by the same permutation.

    Rows are numbered in two hash orders; the row at place ``r`` of the first
    takes the values of the row at place ``r`` of the second, under the names ``out``
    (the columns' own unless given).
    """
    features = [features] if isinstance(features, str) else list(features)
    out = dict(zip(features, out or features, strict=True))

    def order(salt):
        text = F.concat_ws("|", F.lit(f"{seed}{salt}"), *[F.col(k).cast("string") for k in keys])
        return F.md5(text)

    def numbered(frame, salt):
        tagged = frame.withColumn("_h", order(salt)).withColumn(
            "_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
        return rank_in_order(tagged, ["_b"], ["_b"], [F.col("_h"), *map(F.col, keys)], "_place"
                             ).drop("_h", "_b")

    values = numbered(df.select(*keys, *[F.col(f).alias(f"_moved{i}") for i, f in
                                         enumerate(features)]), "b").drop(*keys)
    both = numbered(df, "a").join(values, "_place")
    for i, f in enumerate(features):
        both = both.withColumn(out[f], F.col(f"_moved{i}"))
    return both.select(*df.columns, *[c for c in out.values() if c not in df.columns])


def permutation_importance(df: DataFrame, model: FittedModel, y: str, features=None,
                           keys=("stay_id", "landmark_time"), seed: int = 42) -> DataFrame:
    """Loss of AUROC when one feature is shuffled, over all rows given.

    All features move by one permutation, so the rows are put in order and joined once;
    what is read again per feature is written, and has the model's columns only.
    """
    def measure(frame):
        return auroc(model.score(frame).select(F.col(y).alias("y"), "p"))

    features = list(features or model.features)
    moved = [f"_shuffled{i}" for i in range(len(features))]
    needed = list(dict.fromkeys([*model.features, y, *keys]))
    pairs = materialize(shuffled(df.select(*needed), features, keys, seed, moved).select(
        *dict.fromkeys([*model.features, y]), *moved), "shuffled", run_folder(df.sparkSession))
    base = measure(df).select("auroc").scalar()
    out = None
    for f, other in zip(features, moved):
        part = measure(pairs.withColumn(f, F.col(other)).drop(*moved)).select(
            F.lit(f).alias("feature"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("auroc_full", base).select(
        "feature", "auroc_full", F.col("auroc").alias("auroc_shuffled"),
        (F.col("auroc_full") - F.col("auroc")).alias("importance"))


REFERENCE_FAMILY = "scorecard_augmented_v2"
REFERENCE_STAGE = "stage1"


def explain_all(spark, fitted: dict, matrices: dict, tasks=None, families=None, models=None,
                q: float = 0.85, shortlist_size: int = 200, reranked: int = 10,
                shown: int = 1) -> dict:
    """Tables per (task, family, model): importances, sheets, shapes, cases with their
    contributions, and, for tasks of the first stage, the overlap with the bedside
    reference scorecard. ``shortlist_size`` cases are ranked and ``reranked`` of them
    kept where there is a reference, else ``shown``."""
    triples = spark.createDataFrame(sorted(fitted), "task string, family string, model string")
    wanted = {tuple(r) for r in select_results(triples, tasks, families, models).collect()}
    out = {}
    for triple in sorted(wanted):
        task, family, name = triple
        model, y = fitted[triple], label_column(triple[0])
        tables = {"global_importance": global_importance(spark, model)}
        test = load_split(matrices[family].filter(F.col(y).isNotNull()), "test")
        if name == "boosted":
            tables["permutation_importance"] = permutation_importance(test, model, y)
            tables["mean_attributions"] = mean_attributions(test, model)
        elif name == "additive":
            tables["term_shapes"] = term_shapes(spark, model)
        elif model.extra["representation"] == "binned":
            sheet = sheets.binned_sheet(binned_levels(spark, model))
            tables["scorecard_points"] = sheet
            tables["scorecard"] = sheets.sheet_summary(sheet, model.extra["selected_C"])
        else:
            terms = linear_terms(spark, model)
            tables["scorecard"] = sheets.linear_sheet(terms, model.extra["selected_C"])
            tables["scorecard_points"] = sheets.linear_points(terms)
        keys = list(cases.KEYS)
        missing = sum((F.col(f).isNull().cast("int") for f in model.features), F.lit(0))
        scored = model.score(test).select(*keys, "hours_since_icu_admit", F.col(y).alias("y"),
                                          "p", missing.alias("n_missing"))
        ref = (fitted.get((task, REFERENCE_FAMILY, "scorecard"))
               if REFERENCE_STAGE in task else None)
        if name == "additive" and ref is not None:
            ref_test = load_split(matrices[REFERENCE_FAMILY].filter(F.col(y).isNotNull()), "test")
            ref_p = ref.score(ref_test, "p_reference").select(*keys, "p_reference")
            shortlist = cases.rank_cases(scored, q, ref_p, shortlist_size)
            near = ref_test.join(F.broadcast(shortlist.select(*keys)), keys, "left_semi")
            ref_c = contributions(near, ref, keys)
            chosen = cases.rerank_cases(shortlist, ref_c, reranked)
            tables["reference_contributions"] = ref_c
        else:
            chosen, ref_c = cases.rank_cases(scored, q, None, shown), None
        tables["patient_cases"] = chosen
        own = contributions(test.join(F.broadcast(chosen.select(*keys)), keys, "left_semi"),
                            model, keys)
        tables["patient_contributions"] = own
        if ref_c is not None:
            tables["term_overlap"] = term_overlap(own, ref_c, keys)
        out[triple] = tables
    return out
