"""Bootstrap of scores that many rows share: draws are made once."""

import numpy as np
import pytest

from landmarkflow.evaluation import bootstrap
from landmarkflow.evaluation.bootstrap import Draws, bootstrap_draws

METRICS = ("auroc", "auprc", "brier", "n", "n_pos", "ece", "calibration_slope",
           "calibration_intercept", "sensitivity_at_spec_90", "specificity_at_sens_90")


def tied(spark):
    rng = np.random.default_rng(4)
    n = 3000
    g, y = rng.integers(0, 2, n), rng.integers(0, 2, n)
    p = np.clip((rng.integers(0, 20, n) + 4 * y) / 25.0, 0.01, 0.99)
    return spark.createDataFrame(
        [(int(a), int(b), float(c), f"g{d}") for a, b, c, d in
         zip(rng.integers(0, 90, n), y, p, g)], "subject_id long, y int, p double, g string")


@pytest.mark.parametrize("by", [["g"], []])
def test_counted_scores_equal_runs_of_rows(spark, monkeypatch, by):
    df, got = tied(spark), {}
    for name, rows, chunk in (("rows", 1 << 18, 1 << 15), ("scores", 100, 7)):
        monkeypatch.setattr(bootstrap, "RUN_ROWS", rows)
        monkeypatch.setattr(bootstrap, "CHUNK", chunk)
        monkeypatch.setattr(bootstrap, "RUN_SCORES", 6)
        drawn = bootstrap_draws(df, METRICS, 19, by=by)[1].collect()
        got[name] = {(*[r[c] for c in by], r["iter"]): r for r in drawn}
    assert len(got["rows"]) == 19 * (2 if by else 1) and got["rows"].keys() == got["scores"].keys()
    for k, a in got["rows"].items():
        for m in METRICS:
            assert got["scores"][k][m] == pytest.approx(a[m], rel=1e-9, abs=1e-9), (k, m)


def test_draws_are_made_once(spark, tmp_path):
    """Runs of distinct scores hold the drawn counts, so no pass over them draws again."""
    df = tied(spark)
    scores = bootstrap.patient_scores(df)
    patients = bootstrap.numbered_patients(df.select("subject_id").distinct(), "subject_id")
    place = {r.subject_id: r["_idx"] for r in patients.collect()}
    rows = bootstrap.RUN_ROWS
    try:
        bootstrap.RUN_ROWS = 100
        runs = bootstrap.runs_of(scores, [], patients, "subject_id", len(place), 9,
                                 str(tmp_path)).collect()
    finally:
        bootstrap.RUN_ROWS = rows
    drawn = {p: np.frombuffer(d).reshape(2, 9) for r in runs for p, d in zip(r.p, r.drawn)}
    assert len(drawn) == scores.select("p").distinct().count()
    for b in range(9):
        times, want = Draws(len(place)).counts(b), {}
        for r in scores.collect():
            both = want.setdefault(r.p, [0, 0])
            both[0] += int(times[place[r.subject_id]]) * r.pos
            both[1] += int(times[place[r.subject_id]]) * r.neg
        for p, both in want.items():
            assert drawn[p][:, b].tolist() == both
