"""Metrics against independent numpy formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landmarkflow.config import EvalConfig
from landmarkflow.evaluation import bootstrap, curves, decision, results
from landmarkflow.evaluation import calibration as cal
from landmarkflow.evaluation.bootstrap import Draws, bootstrap_ci, bootstrap_draws
from landmarkflow.evaluation.fairness import flag_disparity, subgroup_report
from landmarkflow.evaluation.report import full_report


def frame(spark, y, p, subject=None, **extra):
    pdf = pd.DataFrame({"y": np.asarray(y, int), "p": np.asarray(p, float),
                        "subject_id": np.arange(len(y)) if subject is None else subject, **extra})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def beta(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    p = np.where(y == 1, rng.beta(5, 2, 400), rng.beta(2, 5, 400))
    p[::7] = np.round(p[::7], 1)  # ties
    return y, p, frame(spark, y, p)


def pair_auroc(y, p):
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_perfect_ranker(spark):
    m = curves.discrimination(curves.score_table(frame(spark, [0, 0, 1, 1],
                                                       [.1, .2, .8, .9]))).first()
    assert m["auroc"] == 1.0 and m["auprc"] == 1.0
    assert m["sensitivity_at_spec_90"] == 1.0 and m["specificity_at_sens_90"] == 1.0


def test_auroc_and_auprc_with_ties(beta):
    y, p, df = beta
    assert curves.auroc(df).first()["auroc"] == pytest.approx(pair_auroc(y, p), abs=1e-12)
    total = sum(((y == 1) & (p == s)).sum() * y[p >= s].mean() for s in np.unique(p))
    assert curves.auprc(df).first()["auprc"] == pytest.approx(total / y.sum(), abs=1e-12)


def test_scores_outside_the_unit_range_rank_too(beta):
    y, p, df = beta
    wide = df.withColumn("p", F.col("p") * 7.0 - 3.0)
    assert curves.auroc(wide).first()["auroc"] == pytest.approx(pair_auroc(y, p), abs=1e-12)


def test_one_class_has_no_auroc(spark):
    m = full_report(frame(spark, [1, 1, 1], [.2, .3, .4])).first()
    assert m["auroc"] is None and m["calibration_slope"] is None and m["n"] == 3


def test_report_keys_and_slope_of_calibrated_scores(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.02, 0.98, 5000)
    y = (rng.uniform(size=5000) < p).astype(int)
    m = full_report(frame(spark, y, p)).first().asDict()
    assert set(m) >= {"auroc", "auprc", "brier", "calibration_slope", "calibration_intercept",
                      "ece", "sensitivity_at_spec_90", "specificity_at_sens_90", "n", "n_pos",
                      "prevalence"}
    assert m["calibration_slope"] == pytest.approx(1.0, abs=0.1)
    assert abs(m["calibration_intercept"]) < 0.15 and m["ece"] < 0.03
    assert m["brier"] == pytest.approx(((p - y) ** 2).mean())
    z = np.log(p / (1 - p))  # the gradient vanishes at the fit
    mu = 1 / (1 + np.exp(-(m["calibration_intercept"] + m["calibration_slope"] * z)))
    assert abs((y - mu).sum()) < 1e-5 and abs(((y - mu) * z).sum()) < 1e-4


def test_separable_scores_do_not_fail(spark):
    row = cal.calibration_fit(frame(spark, [0, 0, 1, 1], [.1, .2, .8, .9])).first()
    assert row["calibration_slope"] > 1


def test_reliability_bins(beta):
    y, p, df = beta
    rows = cal.reliability(df, 10).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == list(range(10)) and sum(r["n"] for r in rows) == len(y)
    idx = np.clip(np.digitize(p, np.linspace(0, 1, 11)) - 1, 0, 9)
    gap = 0.0
    for r in rows:
        hit = idx == r["bin"]
        assert r["n"] == hit.sum()
        if hit.any():
            assert r["pred_mean"] == pytest.approx(p[hit].mean())
            gap += hit.mean() * abs(p[hit].mean() - y[hit].mean())
    assert cal.ece(df).first()["ece"] == pytest.approx(gap)


def test_decision_curve(beta):
    y, p, df = beta
    rows = decision.decision_curve(df).orderBy("threshold").collect()
    assert len(rows) == 50
    for r in rows:
        t, hit = r["threshold"], p >= r["threshold"]
        tp, fp = (hit & (y == 1)).sum(), (hit & (y == 0)).sum()
        assert (r["tp"], r["fp"]) == (tp, fp)
        assert r["nb_model"] == pytest.approx(tp / 400 - fp / 400 * t / (1 - t))
        assert r["nb_all"] == pytest.approx(y.mean() - (1 - y.mean()) * t / (1 - t))
    near = decision.nearest_net_benefit(decision.decision_curve(df), (0.1,)).first()
    assert near["nb_model"] == pytest.approx(
        [r["nb_model"] for r in rows if abs(r["threshold"] - 0.1) < 1e-9][0])


def test_bootstrap_brackets_the_point_and_weights_patients(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    p = np.clip(0.3 * y + rng.uniform(0, 0.7, 300), 0, 1)
    df = frame(spark, y, p, rng.integers(0, 50, 300))
    rows = {r["metric"]: r for r in bootstrap_ci(df, ("auroc", "brier"), 60).collect()}
    assert rows["auroc"]["ci_lower"] <= rows["auroc"]["point"] <= rows["auroc"]["ci_upper"]
    draws = Draws(5000)
    tables = [draws.counts(b) for b in range(40)]
    assert all(t.sum() == 5000 and len(t) == 5000 for t in tables)
    # counts are those of draws with replacement, and iterations do not depend on each other
    assert abs(np.mean([(t == 0).mean() for t in tables]) - np.exp(-1)) < 0.01
    assert abs(np.mean([np.corrcoef(tables[k], tables[k + 1])[0, 1] for k in range(39)])) < 0.01


METRICS = ("auroc", "auprc", "brier", "prevalence", "n", "n_pos", "ece", "calibration_slope",
           "calibration_intercept", "sensitivity_at_spec_90", "specificity_at_sens_90")


@pytest.mark.parametrize("rows", [bootstrap.RUN_ROWS, 9])
def test_iterations_equal_reports_of_repeated_rows(spark, monkeypatch, rows):
    """Each iteration against the full report of its rows spelt out, also with scores that
    many runs share, a group with one class, and many small runs."""
    monkeypatch.setattr(bootstrap, "RUN_ROWS", rows)
    rng = np.random.default_rng(6)
    n = 420
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.25 * y + rng.uniform(0, 0.75, n), 0.02, 0.97), 3)
    p[:140] = rng.choice([0.1, 0.5, 0.9], 140)
    group = np.where(np.arange(n) % 3 == 0, "ties", "mixed")
    group[rng.permutation(n)[:12]] = "one"
    y[group == "one"], p[300:] = 1, p[300]
    df = frame(spark, y, p, rng.integers(0, 40, n), g=group)
    patients = bootstrap.numbered_patients(df.select("subject_id").distinct(), "subject_id")
    place = {r["subject_id"]: r["_idx"] for r in patients.collect()}
    _, drawn = bootstrap_draws(df, METRICS, 3, by=["g"])
    got = {(r["g"], r["iter"]): r for r in drawn.collect()}
    again = df.collect()
    for b in range(3):
        times = Draws(len(place)).counts(b)
        rows_ = [r for r in again for _ in range(times[place[r["subject_id"]]])]
        want = {r["g"]: r for r in full_report(spark.createDataFrame(rows_, df.schema),
                                               ["g"]).collect()}
        for g, w in want.items():
            for m in METRICS:
                have = got[g, b][m]
                if w[m] is None or (m.startswith("s") and w["n_pos"] in (0, w["n"])):
                    assert have is None or np.isnan(have) or m.startswith("s"), (g, b, m)
                else:
                    assert have == pytest.approx(w[m], rel=1e-6, abs=1e-7), (g, b, m)


def test_bootstrap_of_one_patient_is_degenerate(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.integers(0, 2, 100), rng.uniform(size=100), np.zeros(100, int))
    r = bootstrap_ci(df, ("auroc",), 10).first()
    assert r["ci_lower"] == pytest.approx(r["point"]) == pytest.approx(r["ci_upper"])


def test_subgroups_skip_small_and_one_class(spark):
    rng = np.random.default_rng(4)
    n = 400
    sex = np.where(np.arange(n) < 380, "M", "F")
    df = frame(spark, rng.integers(0, 2, n), rng.uniform(size=n), sex=sex,
               age=rng.integers(18, 84, n), ethnicity_group=np.where(sex == "M", "White", "Asian"))
    got = {(r["attribute"], r["value"]) for r in
           subgroup_report(df, EvalConfig(), calibration=False).collect()}
    assert ("sex", "M") in got and ("sex", "F") not in got
    assert ("age_group", "[85, 120]") not in got


def test_disparity_flags(spark):
    rep = spark.createDataFrame([("sex", "M", .80, .5, .10), ("sex", "F", .74, .46, .16),
                                 ("age", "a", .5, .5, .2)],
                                "attribute string, value string, auroc double, auprc double, "
                                "brier double")
    got = {r["value"]: r for r in flag_disparity(rep).collect()}
    assert got["F"]["auroc_disparity_flag"] and got["F"]["brier_disparity_flag"]
    assert not got["F"]["auprc_disparity_flag"] and not got["a"]["auroc_disparity_flag"]


def test_final_results_gate_and_selection(spark):
    ci = spark.createDataFrame([("t", f, "m", k, v, v - .1, v + .1) for f in ("combined", "minimal")
                                for k, v in (("auroc", .8), ("ece", .02),
                                             ("calibration_slope", 1.01))],
                               "task string, family string, model string, metric string, "
                               "point double, ci_lower double, ci_upper double")
    final = results.final_results(ci)
    row = final.filter("family = 'minimal'").first()
    assert (row["auroc"], row["auroc_lo"], row["auroc_hi"]) == pytest.approx((.8, .7, .9))
    assert row["brier"] is None
    gate = results.economy_gate(final).first()
    assert gate["passes_gate"]
    curve = spark.createDataFrame([("t", "combined", "m", 0.05, 0.1)],
                                  "task string, family string, model string, threshold double, "
                                  "nb_model double")
    table = results.economy_table(final, curve).first()  # the other curve is missing
    assert not table["passes_gate"] and table["passes_auroc"]
    assert results.best_per_task(final).first()["family"] == "combined"
