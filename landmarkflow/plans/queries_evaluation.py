"""Queries on metrics, calibration, decision curves, bootstrap and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landmarkflow.evaluation import calibration as cal
from landmarkflow.evaluation import curves, decision, fairness, results
from landmarkflow.evaluation.bootstrap import bootstrap_ci
from landmarkflow.evaluation.report import full_report
from landmarkflow.operators.features import group_category
from landmarkflow.operators.joins import align_frames
from landmarkflow.plans.registry import query

TRIPLE = list(results.TRIPLE)


def test_rows(c):
    return c.fx.scored.filter(F.col("split") == "test")


def predictions(c):
    """Scored rows of four (task, family) pairs of one model, with patient attributes."""
    rows = test_rows(c)
    second = F.when((F.col("y") == 1) & (F.col("l_linestatus") == "F"), 1).otherwise(0)
    small = (F.col("p") * 51.0 + F.col("l_linenumber")) / 60.0
    cells = [("aki_stage1_24h", "combined", F.col("y"), F.col("p")),
             ("aki_stage1_24h", "minimal", F.col("y"), small),
             ("aki_stage2_24h", "combined", second, F.col("p") / 2.0),
             ("aki_stage2_24h", "minimal", second, small / 3.0)]
    items = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(f).alias("family"),
                               F.lit("additive").alias("model"), y.cast("int").alias("y"),
                               p.alias("p")) for t, f, y, p in cells])
    people = c.fx.table("customer").select(
        F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 80 + 10).alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("sex"),
        group_category("c_mktsegment", c.cfg.ethnicity_groups).alias("ethnicity_group"))
    long = rows.select("l_orderkey", "l_linenumber", "subject_id", F.explode(items).alias("_x"))
    return long.select("l_orderkey", "l_linenumber", "subject_id", "_x.*").join(people,
                                                                               "subject_id")


def summary(c):
    return full_report(predictions(c), TRIPLE)


@query("e1_roc_curve", 9)
def _(c):
    return curves.roc(c.fx.scored, ["split"])


@query("e1_auroc", 9)
def _(c):
    return curves.auroc(c.fx.scored, ["split"])


@query("e2_auprc", 9)
def _(c):
    return curves.auprc(c.fx.scored, ["split"])


@query("e3_operating_points", 9)
def _(c):
    return curves.operating_points(c.fx.scored, 0.90, ["split"])


@query("e4_basic_metrics", 9)
def _(c):
    return curves.basic_metrics(c.fx.scored, ["split"])


@query("e5_calibration_fit", 6)
def _(c):
    return cal.calibration_fit(c.fx.scored, ["split"])


@query("e6_ece", 9)
def _(c):
    return cal.ece(c.fx.scored, 10, ["split"])


@query("e7_reliability", 9)
def _(c):
    """All rows, their scores shrunk to [0, 0.9], so that the last bin is empty."""
    return cal.reliability(test_rows(c).withColumn("p", F.col("p") * 0.875), 10)


@query("e8_decision_curve", 9)
def _(c):
    return decision.decision_curve(test_rows(c))


@query("e9_net_benefit_at", 9)
def _(c):
    near = decision.nearest_net_benefit(decision.decision_curve(test_rows(c)), (0.05, 0.1, 0.2))
    at = decision.net_benefit_at(test_rows(c), 0.2)
    return near.select(F.lit("nearest").alias("kind"), F.col("wanted").alias("threshold"),
                       "nb_model").unionByName(at.select(F.lit("exact").alias("kind"),
                                                         "threshold", "nb_model"))


@query("e10_full_report", 6)
def _(c):
    return summary(c)


@query("e11_bootstrap_ci", 9)
def _(c):
    return bootstrap_ci(test_rows(c), ("auroc", "auprc", "brier", "prevalence", "n_pos"),
                        c.cfg.evaluation.bootstrap_iterations)


@query("e12_subgroup_report", 6)
def _(c):
    report = fairness.subgroup_report(predictions(c), c.cfg.evaluation, TRIPLE, False)
    return report.drop(*[x for x in report.columns if x.endswith("_flag")])


@query("e13_disparity_flags", 6)
def _(c):
    report = fairness.subgroup_report(predictions(c), c.cfg.evaluation, TRIPLE, False)
    return fairness.flag_disparity(report.select(*TRIPLE, "attribute", "value", "auroc", "auprc",
                                                 "brier"), 0.01, TRIPLE)


@query("e14_economy_gate", 6)
def _(c):
    return results.economy_gate(summary(c), c.cfg.evaluation)


@query("e15_economy_table", 6)
def _(c):
    rows = predictions(c)
    out = results.economy_table(summary(c), decision.decision_curve(rows, by=TRIPLE),
                                c.cfg.evaluation)
    return out.toDF(*[n.replace("0.05", "005").replace("0.1", "010").replace("0.2", "020")
                      for n in out.columns])


@query("e16_evaluate_all", 6)
def _(c):
    return results.evaluate_all(predictions(c), c.cfg.evaluation)["final_results"]


@query("e17_final_results", 9)
def _(c):
    """Interval rows of subgroup-like metrics pivoted per triple."""
    base = curves.basic_metrics(predictions(c), TRIPLE)
    long = base.select(*TRIPLE, F.col("brier"), F.col("prevalence").alias("auroc")).unpivot(
        TRIPLE, ["brier", "auroc"], "metric", "point")
    ci = long.select("*", (F.col("point") - 0.01).alias("ci_lower"),
                     (F.col("point") + 0.02).alias("ci_upper"))
    return results.final_results(ci, ("auroc", "brier", "ece"))


@query("k3_best_per_task", 6)
def _(c):
    report = full_report(predictions(c), TRIPLE, calibration=False)
    return results.best_per_task(report.select(*TRIPLE, "auroc", "auprc", "brier"))


@query("j16_align_frames", 9)
def _(c):
    ev = c.fx.events.select("subject_id", "event_id", "value")
    a = ev.select("subject_id", "event_id", (F.col("value") / 500.0).alias("p"))
    b = ev.select("subject_id", (F.col("event_id") * 2).alias("event_id"),
                  (F.col("value") / 400.0).alias("p_reference"))
    return align_frames(a, b, ["subject_id", "event_id"], ["p_reference"])


@query("j17_compare_families", 6)
def _(c):
    report = full_report(predictions(c), TRIPLE, calibration=False)
    return results.compare_families(report, "combined", "minimal", ("auroc", "ece", "brier"))
