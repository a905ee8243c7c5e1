"""Result tables over (task, family, model): comparisons, gates, final table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.config import KEY_METRICS, EvalConfig
from landmarkflow.evaluation.decision import nearest_net_benefit

TRIPLE = ("task", "family", "model")


def final_results(ci: DataFrame, metrics=KEY_METRICS) -> DataFrame:
    """Interval rows to one row per triple with ``m, m_lo, m_hi`` per metric."""
    wide = ci.groupBy(*TRIPLE).pivot("metric", list(metrics)).agg(
        F.first("point").alias("point"), F.first("ci_lower").alias("lo"),
        F.first("ci_upper").alias("hi"))
    cols = []
    for m in metrics:
        cols += [F.col(f"{m}_point").alias(m), F.col(f"{m}_lo"), F.col(f"{m}_hi")]
    return wide.select(*TRIPLE, *cols)


def best_per_task(results: DataFrame, metric: str = "auroc") -> DataFrame:
    """Best row per task; ties go to the first (family, model)."""
    order = Window.partitionBy("task").orderBy(F.desc_nulls_last(metric), "family", "model")
    return results.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def compare_families(results: DataFrame, a: str, b: str, metrics=("auroc", "calibration_slope",
                                                                  "ece")) -> DataFrame:
    """Metrics of two families side by side per (task, model)."""
    def side(name):
        return results.filter(F.col("family") == name).select(
            "task", "model", *[F.col(m).alias(f"{m}_{name}") for m in metrics])
    return side(a).join(side(b), ["task", "model"])


def economy_gate(results: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """Does the small family come close enough to the full one?"""
    m = compare_families(results, "combined", "minimal")
    m = m.select("*", (F.col("auroc_combined") - F.col("auroc_minimal")).alias("delta_auroc"),
                 (F.col("ece_minimal") - F.col("ece_combined")).alias("delta_ece"),
                 F.abs(F.col("calibration_slope_minimal") - 1.0).alias("minimal_slope_error"))
    ranks = F.coalesce(F.col("delta_auroc") <= cfg.auroc_tolerance, F.lit(False))
    fits = F.coalesce((F.col("minimal_slope_error") <= cfg.slope_tolerance)
                      & (F.col("delta_ece") <= cfg.ece_tolerance), F.lit(False))
    return m.select("*", ranks.alias("passes_auroc"), fits.alias("passes_calibration"),
                    (ranks & fits).alias("passes_gate"))


def economy_table(results: DataFrame, curves: DataFrame, cfg: EvalConfig = EvalConfig()
                  ) -> DataFrame:
    """The gate plus net-benefit differences at the clinical thresholds.

    A missing decision curve fails the gate.
    """
    near = nearest_net_benefit(curves, cfg.clinical_thresholds, TRIPLE)

    def side(name):
        return near.filter(F.col("family") == name).select(
            "task", "model", "wanted", F.col("nb_model").alias(name))

    both = side("combined").join(side("minimal"), ["task", "model", "wanted"])
    names = [f"delta_net_benefit_at_{t:g}" for t in cfg.clinical_thresholds]
    deltas = both.groupBy("task", "model").agg(*[
        F.max(F.when(F.col("wanted") == t, F.col("minimal") - F.col("combined"))).alias(n)
        for t, n in zip(cfg.clinical_thresholds, names, strict=True)])
    out = economy_gate(results, cfg).drop("passes_gate").join(deltas, ["task", "model"], "left")
    useful = reduce(lambda a, b: a & b, [
        F.coalesce(F.col(f"`{n}`") >= -cfg.net_benefit_tolerance, F.lit(False)) for n in names])
    return out.select("*", useful.alias("passes_decision_curve"),
                      (F.col("passes_auroc") & F.col("passes_calibration") & useful)
                      .alias("passes_gate"))


def evaluate_all(predictions: DataFrame, cfg: EvalConfig = EvalConfig(), tasks=None,
                 families=None, models=None, iterations: int | None = None) -> dict:
    """Every table of the test evaluation from one long prediction relation.

    ``predictions`` holds ``task, family, model, subject_id, y, p`` and patient
    attributes for all models, so each table is one grouped aggregation.
    """
    from landmarkflow.evaluation.bootstrap import bootstrap_ci
    from landmarkflow.evaluation.calibration import reliability
    from landmarkflow.evaluation.decision import decision_curve, thresholds
    from landmarkflow.evaluation.fairness import subgroup_report
    from landmarkflow.evaluation.report import full_report
    from landmarkflow.operators.features import select_results

    rows = select_results(predictions, tasks, families, models)
    by = list(TRIPLE)
    grid = thresholds(cfg.threshold_min, cfg.threshold_max, cfg.threshold_step)
    summary = full_report(rows, by, cfg.calibration_bins)
    ci = bootstrap_ci(rows, KEY_METRICS, iterations or cfg.bootstrap_iterations, cfg.confidence,
                      by=by, bins=cfg.calibration_bins)
    curves = decision_curve(rows, grid, by)
    final = final_results(ci)
    return {"test_summary": summary, "bootstrap_ci": ci, "decision_curve": curves,
            "reliability_curve": reliability(rows, cfg.calibration_bins, by),
            "fairness": subgroup_report(rows, cfg, by), "final_results": final,
            "best_per_task": best_per_task(final), "economy_gate": economy_gate(summary, cfg),
            "input_economy": economy_table(final, curves, cfg)}
