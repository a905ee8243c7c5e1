"""Oracles for evaluation: ranks, self-joins over thresholds, unrolled Newton steps."""

from __future__ import annotations

from oracles import features as _features  # noqa: F401
from oracles.base import assemble, cte

ORACLES = {}


def oracle(name: str, sql: str, digits: int | None = None, doubles: str = "") -> None:
    if doubles:
        cols = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles.split())
        sql = f"SELECT * REPLACE ({cols}) FROM (\n{sql.strip()}\n) AS q"
    ORACLES[name] = assemble(sql)


def rank_auroc(rel: str, by: str) -> str:
    """Mann-Whitney form from average ranks."""
    return f"""
SELECT {by}, (sum(r) FILTER (y = 1) - np * (np + 1) / 2) / (np * (n - np)) AS auroc
FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p)
        + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2 AS r,
        sum(y) OVER (PARTITION BY {by})::DOUBLE AS np,
        (count(*) OVER (PARTITION BY {by}))::DOUBLE AS n FROM {rel})
GROUP BY {by}, np, n"""


def curve(rel: str, by: str, w: str = "1") -> str:
    """One row per distinct score: counts at or above it, by running sums over scores."""
    return f"""
SELECT {by}, p, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp,
  CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER g AS np, sum(neg) OVER g AS nn
FROM (SELECT {by}, p, sum(y * {w}) AS pos, sum((1 - y) * {w}) AS neg FROM {rel} GROUP BY ALL)
WINDOW w AS (PARTITION BY {by} ORDER BY p DESC), g AS (PARTITION BY {by})"""


def summary(rel: str, by: str, curve_rel: str) -> str:
    """Ranking measures from curve points."""
    return f"""
SELECT {by}, sum(neg::DOUBLE * (tp - pos / 2.0::DOUBLE)) / (max(np)::DOUBLE * max(nn)) AS auroc,
  sum(pos::DOUBLE / np * tp / (tp + fp)) AS auprc,
  max(np)::DOUBLE / (max(np) + max(nn)) AS prevalence,
  CAST(max(np) + max(nn) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS n_pos,
  coalesce(max(tp::DOUBLE / np) FILTER (1 - fp::DOUBLE / nn >= 0.9), 0) AS sensitivity_at_spec_90,
  max(1 - fp::DOUBLE / nn) FILTER (tp::DOUBLE / np >= 0.9) AS specificity_at_sens_90,
  (sum(pos * (1 - p) ** 2) + sum(neg * p ** 2)) / (max(np) + max(nn)) AS brier
FROM {curve_rel} GROUP BY {by}"""


EDGES = [i * 0.1 for i in range(10)]
BIN = "(" + " + ".join(f"CAST({{p}} >= {e!r}::DOUBLE AS INTEGER)" for e in EDGES) + " - 1)"


def bin_of(p: str) -> str:
    return f"greatest(least({BIN.format(p=p)}, 9), 0)"


def ece(rel: str, by: str) -> str:
    clipped = "least(greatest(p, 1e-9), 1 - 1e-9)"
    return f"""
SELECT {by}, sum(n / total * abs(mp - my)) AS ece
FROM (SELECT {by}, {bin_of(clipped)} AS b, count(*) AS n, avg({clipped}) AS mp, avg(y) AS my,
        sum(count(*)) OVER (PARTITION BY {by}) AS total FROM {rel} GROUP BY {by}, b)
GROUP BY {by}"""


def newton(prefix: str, rel: str, by: str, steps: int = 14) -> str:
    """Unrolled Newton steps for the logistic fit of y on logit(p); returns the last CTE."""
    cte(f"{prefix}_z", f"""
SELECT {by}, ln(c / (1 - c)) AS z, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n
FROM (SELECT *, least(greatest(p, 1e-9), 1 - 1e-9) AS c FROM {rel}) GROUP BY ALL""")
    cte(f"{prefix}_0", f"SELECT DISTINCT {by}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {rel}")
    for i in range(1, steps + 1):
        cte(f"{prefix}_{i}", f"""
SELECT {by}, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
  b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b
FROM (SELECT {by}, a, b, sum(s - n * mu) AS g0, sum((s - n * mu) * z) - b / 1e6 AS g1,
        sum(n * mu * (1 - mu)) AS h00, sum(n * mu * (1 - mu) * z) AS h01,
        sum(n * mu * (1 - mu) * z * z) + 1e-6 AS h11
      FROM (SELECT *, 1 / (1 + exp(-(a + b * z))) AS mu
            FROM {prefix}_z JOIN {prefix}_{i - 1} USING ({by})) GROUP BY {by}, a, b)""")
    return f"{prefix}_{steps}"


cte("split_curve", curve("scored", "split"))
cte("split_summary", summary("scored", "split", "split_curve"))
oracle("e1_roc_curve", """
SELECT split, p AS threshold, tp, fp, tp / np::DOUBLE AS tpr, fp / nn::DOUBLE AS fpr
FROM split_curve""", 9, "threshold tpr fpr")
oracle("e1_auroc", rank_auroc("scored", "split"), 9, "auroc")
oracle("e2_auprc", """
SELECT a.split, sum(a.k * (SELECT avg(y) FROM scored s WHERE s.split = a.split AND s.p >= a.p))
  / sum(a.k) AS auprc
FROM (SELECT split, p, sum(y)::DOUBLE AS k FROM scored GROUP BY 1, 2) a GROUP BY 1""", 9, "auprc")
oracle("e3_operating_points", """
SELECT split, sensitivity_at_spec_90, specificity_at_sens_90 FROM split_summary""", 9,
       "sensitivity_at_spec_90 specificity_at_sens_90")
oracle("e4_basic_metrics", """
SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(y) AS prevalence,
  avg((p - y) ** 2) AS brier FROM scored GROUP BY 1""", 9, "prevalence brier")
_fit = newton("nw", "scored", "split")
oracle("e5_calibration_fit", f"SELECT split, b AS calibration_slope, a AS calibration_intercept "
       f"FROM {_fit}", 6, "calibration_slope calibration_intercept")
oracle("e6_ece", ece("scored", "split"), 9, "ece")
_rows = ", ".join(f"({i}, {EDGES[i]!r}::DOUBLE, {(EDGES + [1.0])[i + 1]!r}::DOUBLE)"
                  for i in range(10))
oracle("e7_reliability", f"""
SELECT g.bin, bin_left, bin_right, count(p) AS n, avg(p) AS pred_mean, avg(y) AS obs_rate
FROM (VALUES {_rows}) AS g(bin, bin_left, bin_right)
LEFT JOIN (SELECT p, y, {bin_of('p')} AS bin FROM (
  SELECT p * 0.875::DOUBLE AS p, y FROM scored WHERE split = 'test')) s
  ON s.bin = g.bin GROUP BY 1, 2, 3""", 9, "bin_left bin_right pred_mean obs_rate")
GRID = [0.01 + i * 0.01 for i in range(50)]
_grid = ", ".join(f"({t!r}::DOUBLE)" for t in GRID)


def decision(rel: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""
SELECT {keys}t AS threshold, tp / n - fp / n * t / (1 - t) AS nb_model,
  np / n - (1 - np / n) * t / (1 - t) AS nb_all, 0.0::DOUBLE AS nb_none, tp, fp, n
FROM (SELECT {keys}t, count(*) FILTER (p >= t AND y = 1) AS tp,
        count(*) FILTER (p >= t AND y = 0) AS fp, count(*) AS n,
        count(*) FILTER (y = 1) AS np
      FROM {rel}, (VALUES {_grid}) AS g(t) GROUP BY {keys}t)"""


cte("test_scored", "SELECT * FROM scored WHERE split = 'test'")
cte("dcurve", decision("test_scored"))
oracle("e8_decision_curve", "SELECT * FROM dcurve", 9, "threshold nb_model nb_all nb_none")
oracle("e9_net_benefit_at", """
SELECT 'nearest' AS kind, w::DOUBLE AS threshold, (SELECT nb_model FROM dcurve
  ORDER BY abs(threshold - w), threshold LIMIT 1) AS nb_model
FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) AS v(w)
UNION ALL SELECT 'exact', 0.2::DOUBLE, avg(CASE WHEN p < 0.2::DOUBLE THEN 0 WHEN y = 1 THEN 1
  ELSE -0.25 END) FROM test_scored""", 9, "threshold nb_model")
# --- predictions ---------------------------------------------------------------------------
cte("preds", """
SELECT x.l_orderkey, x.l_linenumber, x.subject_id, 10 + c_custkey % 80 AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'White' WHEN 'BUILDING' THEN 'Black'
    WHEN 'AUTOMOBILE' THEN 'Hispanic' WHEN 'FURNITURE' THEN 'Asian' ELSE 'Other' END
    AS ethnicity_group, task, family, 'additive' AS model,
  CASE task WHEN 'aki_stage1_24h' THEN y ELSE CAST(y = 1 AND l_linestatus = 'F' AS INTEGER) END
    AS y,
  CASE family WHEN 'combined' THEN p ELSE (p * 51.0::DOUBLE + x.l_linenumber) / 60.0::DOUBLE END
    / CASE WHEN task = 'aki_stage1_24h' THEN 1.0::DOUBLE WHEN family = 'combined'
           THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS p
FROM test_scored x JOIN customer ON c_custkey = x.subject_id,
  (VALUES ('aki_stage1_24h'), ('aki_stage2_24h')) AS t(task),
  (VALUES ('combined'), ('minimal')) AS f(family)""")
BY = "task, family, model"
cte("pred_curve", curve("preds", BY))
cte("pred_sum", summary("preds", BY, "pred_curve"))
cte("pred_ece", ece("preds", BY))
_pfit = newton("pw", "preds", BY)
cte("pred_report", f"""
SELECT s.*, ece, b AS calibration_slope, a AS calibration_intercept
FROM pred_sum s JOIN pred_ece USING ({BY}) JOIN {_pfit} USING ({BY})""")
RANK = ("auroc auprc prevalence sensitivity_at_spec_90 specificity_at_sens_90 brier")
oracle("e10_full_report", "SELECT * FROM pred_report", 6,
       RANK + " ece calibration_slope calibration_intercept")
# --- bootstrap -------------------------------------------------------------------------------
cte("subj", """
SELECT subject_id, row_number() OVER (ORDER BY substr(md5(subject_id::VARCHAR), 1, 3),
  subject_id) - 1 AS i FROM (SELECT DISTINCT subject_id FROM test_scored)""")
def mix32(x: str) -> str:
    """Nested form of the 32-bit finalizer the draws are made with."""
    def step(shift: int, x: str, factor: str) -> str:
        return f"((xor({x}, {x} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT)"
    x = step(13, step(16, f"({x})::UBIGINT", "2246822507"), "3266489909")
    return f"xor({x}, {x} >> 16)"


cte("slots", f"SELECT i, {mix32('i')} AS h FROM subj")
cte("rounds", f"SELECT b, {mix32('b + 1')} AS h FROM (SELECT unnest(range(0, 1000)) AS b)")
cte("draws", f"""
SELECT b, (h * n) >> 32 AS pick
FROM (SELECT b, {mix32('h')} AS h FROM (
  SELECT b, xor(s.h, r.h) AS h FROM slots s, rounds r)),
  (SELECT count(*)::UBIGINT AS n FROM subj)""")
cte("resampled", """
SELECT b, y, p FROM draws JOIN subj ON subj.i = pick
JOIN test_scored t ON t.subject_id = subj.subject_id""")
cte("boot_curve", curve("resampled", "b"))
cte("boot_sum", summary("resampled", "b", "boot_curve"))
cte("one_scored", "SELECT 0 AS b, y, p FROM test_scored")
cte("one_curve", curve("one_scored", "b"))
cte("one_sum", summary("one_scored", "b", "one_curve"))
oracle("e11_bootstrap_ci", " UNION ALL ".join(f"""
SELECT '{m}' AS metric, (SELECT {m}::DOUBLE FROM one_sum) AS point,
  quantile_cont({m}::DOUBLE, (1.0::DOUBLE - 0.95::DOUBLE) / 2) AS ci_lower,
  quantile_cont({m}::DOUBLE, 1.0::DOUBLE - (1.0::DOUBLE - 0.95::DOUBLE) / 2) AS ci_upper
FROM boot_sum""" for m in ("auroc", "auprc", "brier", "prevalence", "n_pos")), 9,
       "point ci_lower ci_upper")
# --- subgroups ---------------------------------------------------------------------------------
cte("sub_all", f"""
SELECT {BY}, y, p, 'sex' AS attribute, sex AS value FROM preds
UNION ALL SELECT {BY}, y, p, 'ethnicity_group', ethnicity_group FROM preds
UNION ALL SELECT {BY}, y, p, 'age_group', '[' || lo || ', ' || hi || ']' FROM preds
JOIN (VALUES (18, 45), (45, 65), (65, 85), (85, 120)) AS g(lo, hi) ON age >= lo AND age < hi""")
SBY = BY + ", attribute, value"
cte("sub_rows", f"""
SELECT *, rank() OVER (ORDER BY {SBY}) AS g FROM sub_all
QUALIFY count(*) OVER (PARTITION BY {SBY}) >= 100
  AND min(y) OVER (PARTITION BY {SBY}) < max(y) OVER (PARTITION BY {SBY})""")
cte("sub_curve", curve("sub_rows", SBY))
cte("sub_sum", summary("sub_rows", SBY, "sub_curve"))
cte("sub_ece", ece("sub_rows", SBY))
oracle("e12_subgroup_report", f"""
SELECT s.*, ece FROM sub_sum s JOIN sub_ece USING ({SBY})""", 6, RANK + " ece")
oracle("e13_disparity_flags", f"""
SELECT {SBY}, auroc, auprc, brier,
  max(auroc) OVER w - auroc > 0.01 AS auroc_disparity_flag,
  max(auprc) OVER w - auprc > 0.01 AS auprc_disparity_flag,
  brier - min(brier) OVER w > 0.01 AS brier_disparity_flag
FROM sub_sum WINDOW w AS (PARTITION BY {BY}, attribute)""", 6, "auroc auprc brier")
# --- result tables -------------------------------------------------------------------------------
cte("gate", """
SELECT c.task, c.model, c.auroc AS auroc_combined, c.calibration_slope
  AS calibration_slope_combined, c.ece AS ece_combined, m.auroc AS auroc_minimal,
  m.calibration_slope AS calibration_slope_minimal, m.ece AS ece_minimal,
  c.auroc - m.auroc AS delta_auroc, m.ece - c.ece AS delta_ece,
  abs(m.calibration_slope - 1) AS minimal_slope_error,
  c.auroc - m.auroc <= 0.02 AS passes_auroc,
  abs(m.calibration_slope - 1) <= 0.05 AND m.ece - c.ece <= 0.02 AS passes_calibration,
  passes_auroc AND passes_calibration AS passes_gate
FROM pred_report c JOIN pred_report m ON m.task = c.task AND m.model = c.model
WHERE c.family = 'combined' AND m.family = 'minimal'""")
GATE = ("auroc_combined calibration_slope_combined ece_combined auroc_minimal "
        "calibration_slope_minimal ece_minimal delta_auroc delta_ece minimal_slope_error")
oracle("e14_economy_gate", "SELECT * FROM gate", 6, GATE)
cte("pred_dc", decision("preds", BY))


def near(family: str, t: float) -> str:
    return (f"(SELECT nb_model FROM pred_dc d WHERE d.task = gate.task AND d.model = gate.model "
            f"AND d.family = '{family}' ORDER BY abs(threshold - {t}), threshold LIMIT 1)")


oracle("e15_economy_table", """
SELECT g.* EXCLUDE (passes_gate), d005 >= 0 AND d010 >= 0 AND d020 >= 0 AS passes_decision_curve,
  passes_gate AND d005 >= 0 AND d010 >= 0 AND d020 >= 0 AS passes_gate,
  d005 AS delta_net_benefit_at_005, d010 AS delta_net_benefit_at_010,
  d020 AS delta_net_benefit_at_020
FROM gate g JOIN (SELECT task, model, """ + ", ".join(
    f"{near('minimal', t)} - {near('combined', t)} AS {n}"
    for t, n in ((0.05, "d005"), (0.1, "d010"), (0.2, "d020"))) + """ FROM gate) d
ON d.task = g.task AND d.model = g.model""", 6, GATE + " delta_net_benefit_at_005 "
       "delta_net_benefit_at_010 delta_net_benefit_at_020")
oracle("e17_final_results", f"""
SELECT {BY}, avg(y) AS auroc, avg(y) - 0.01 AS auroc_lo, avg(y) + 0.02 AS auroc_hi,
  avg((p - y) ** 2) AS brier, avg((p - y) ** 2) - 0.01 AS brier_lo,
  avg((p - y) ** 2) + 0.02 AS brier_hi, NULL::DOUBLE AS ece, NULL::DOUBLE AS ece_lo,
  NULL::DOUBLE AS ece_hi FROM preds GROUP BY {BY}""", 9,
       "auroc auroc_lo auroc_hi brier brier_lo brier_hi")
oracle("k3_best_per_task", f"""
SELECT {BY}, auroc, auprc, brier FROM pred_sum
QUALIFY row_number() OVER (PARTITION BY task ORDER BY auroc DESC, family, model) = 1""", 6,
       "auroc auprc brier")
oracle("j16_align_frames", """
SELECT a.subject_id, a.event_id, a.value / 500.0 AS p, b.value / 400.0 AS p_reference
FROM ev a JOIN ev b ON a.event_id = b.event_id * 2 AND a.subject_id = b.subject_id""", 9, "p p_reference")
oracle("j17_compare_families", """
SELECT c.task, c.model, c.auroc AS auroc_combined, c.ece AS ece_combined,
  c.brier AS brier_combined, m.auroc AS auroc_minimal, m.ece AS ece_minimal,
  m.brier AS brier_minimal
FROM pred_report c JOIN pred_report m ON m.task = c.task
WHERE c.family = 'combined' AND m.family = 'minimal'""", 6,
       "auroc_combined ece_combined brier_combined auroc_minimal ece_minimal brier_minimal")
