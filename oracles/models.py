"""Oracles for score-sheet design, contributions and case selection."""

from __future__ import annotations

from oracles import evaluation as _evaluation  # noqa: F401
from oracles.base import assemble, cte

ORACLES = {}


def oracle(name: str, sql: str, digits: int | None = None, doubles: str = "") -> None:
    if doubles:
        cols = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles.split())
        sql = f"SELECT * REPLACE ({cols}) FROM (\n{sql.strip()}\n) AS q"
    ORACLES[name] = assemble(sql)


FEATURES = ("quantity", "price", "discount", "tax", "flag")
cte("trows", """
SELECT l_orderkey AS stay_id, subject_id, l_linenumber, split, l_quantity AS quantity,
  l_extendedprice / 1000.0 AS price, l_discount AS discount,
  CASE WHEN l_linenumber % 6 <> 0 THEN l_tax END AS tax,
  CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag,
  CAST((l_quantity * l_discount > 1.2::DOUBLE) <> (l_orderkey % 11 = 0) AS INTEGER) AS y
FROM scored""")
cte("train_rows", "SELECT * FROM trows WHERE split = 'train'")
cte("tlong", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, y FROM train_rows" for f in FEATURES))
cte("profile", """
SELECT feature, CASE WHEN bool_and(value IN (0, 1)) THEN 'binary' ELSE 'continuous' END AS kind,
  count(*) - count(value) AS missing_count, count(value) AS n_observed,
  quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25,
  quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
  quantile_cont(value, 0.9) AS q90, median(value) AS impute_median
FROM tlong GROUP BY feature""")
oracle("m2_select_c", """
SELECT C, auroc, auprc, brier, mean_nonzero, CASE WHEN fits THEN
  'within_tolerance_and_within_budget' ELSE 'within_tolerance' END AS selection_rule,
  row_number() OVER (ORDER BY ok DESC, mean_nonzero, brier, auprc DESC, C) = 1 AS selected
FROM (SELECT *, CASE WHEN fits THEN near AND mean_nonzero <= 10 ELSE near END AS ok
  FROM (SELECT *, bool_or(near AND mean_nonzero <= 10) OVER () AS fits
    FROM (SELECT *, auroc >= max(auroc) OVER () - 0.01 AS near
      FROM (SELECT (l_suppkey % 9 + 1) / 10.0 AS C, round(avg(l_discount), 4) * 10 AS auroc,
        round(avg(l_tax), 4) AS brier, round(avg(l_quantity) / 100, 4) AS auprc,
        (count(*) % 13)::DOUBLE AS mean_nonzero FROM lineitem GROUP BY l_suppkey % 9))))""", 6,
       "C auroc auprc brier mean_nonzero")
QS = "q10 q25 q50 q75 q90 impute_median"
oracle("m3_feature_profiles", "SELECT * FROM profile", 9, QS)
EDGES = {"quantity": (10, 25, 40), "price": (20, 50, 75.5), "discount": (0.02, 0.05, 0.08),
         "tax": (0.02, 0.05)}


def levels() -> str:
    rows = []
    for f, cuts in EDGES.items():
        for i in range(len(cuts) + 1):
            lo = f"{float(cuts[i - 1])!r}::DOUBLE" if i else "NULL::DOUBLE"
            hi = f"{float(cuts[i])!r}::DOUBLE" if i < len(cuts) else "NULL::DOUBLE"
            a = f"{cuts[i - 1]:g}" if i else ""
            b = f"{cuts[i]:g}" if i < len(cuts) else ""
            text = f"< {b}" if not a else f">= {a}" if not b else f"{a} to < {b}"
            rows.append(f"('{f}', 'binned_continuous', {i}, '{text}', {lo}, {hi})")
    rows += ["('flag', 'binary', 0, '0 / absent', NULL::DOUBLE, NULL::DOUBLE)",
             "('flag', 'binary', 1, '1 / present', NULL::DOUBLE, NULL::DOUBLE)"]
    return ", ".join(rows)


cte("levels", f"""
SELECT l.*, CASE WHEN l.kind = 'binary' THEN bin_index = 0
    ELSE impute_median >= coalesce(lower_bound, '-inf'::DOUBLE)
     AND impute_median < coalesce(upper_bound, 'inf'::DOUBLE) END AS reference, impute_median
FROM (VALUES {levels()}) AS l(feature, kind, bin_index, level_label, lower_bound, upper_bound)
JOIN profile p ON p.feature = l.feature""")
HIT = """CASE WHEN l.kind = 'binary' THEN {v} = bin_index
    ELSE {v} >= coalesce(lower_bound, '-inf'::DOUBLE)
     AND {v} < coalesce(upper_bound, 'inf'::DOUBLE) END"""
cte("bins", f"""
SELECT l.feature, l.kind, bin_index, level_label, level_label AS range_display, lower_bound,
  upper_bound, reference, CASE WHEN reference THEN NULL WHEN l.kind = 'binary' THEN l.feature
    ELSE l.feature || '__bin_' || bin_index END AS term_name,
  count(y) AS train_n, CAST(sum(y) AS BIGINT) AS train_events, avg(y) AS train_event_rate
FROM levels l JOIN tlong t ON t.feature = l.feature
  AND {HIT.format(v='coalesce(t.value, impute_median)')} GROUP BY ALL""")
oracle("m3_fit_bins", "SELECT * FROM bins", 9, "lower_bound upper_bound train_event_rate")
cte("all_long", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, split, stay_id, l_linenumber FROM trows"
    for f in FEATURES))
oracle("m3_transform_bins", f"""
SELECT split, CASE WHEN l.kind = 'binary' THEN l.feature ELSE l.feature || '__bin_' || bin_index
  END AS term, count(*) FILTER ({HIT.format(v='coalesce(t.value, impute_median)')}) AS n
FROM levels l JOIN all_long t ON t.feature = l.feature WHERE NOT reference GROUP BY 1, 2""")
# --- contributions ---------------------------------------------------------------------------
oracle("x2_linear_contributions", """
SELECT stay_id, l_linenumber, subject_id, t.feature, value, (x - mean) / scale AS scaled_value,
  coefficient, coefficient * ((x - mean) / scale) AS contribution_logodds
FROM (SELECT r.stay_id, r.l_linenumber, r.subject_id, u.feature, u.value,
        coalesce(u.value, u.med) AS x
      FROM trows r, LATERAL (VALUES ('quantity', r.quantity, 25.0::DOUBLE),
        ('price', r.price, 38.0::DOUBLE), ('discount', r.discount, 0.05::DOUBLE),
        ('tax', r.tax, 0.04::DOUBLE)) AS u(feature, value, med) WHERE split = 'test') d
JOIN (VALUES ('quantity', 0.8::DOUBLE, 25.5::DOUBLE, 14.5::DOUBLE),
  ('price', -0.5::DOUBLE, 40.0::DOUBLE, 22.0::DOUBLE),
  ('discount', 1.25::DOUBLE, 0.05::DOUBLE, 0.03::DOUBLE),
  ('tax', 0.1::DOUBLE, 0.04::DOUBLE, 0.025::DOUBLE)) AS t(feature, coefficient, mean, scale)
ON t.feature = d.feature""", 9, "value scaled_value coefficient contribution_logodds")
COEF = "CASE WHEN reference THEN 0 ELSE bin_index * 0.3::DOUBLE - 0.4::DOUBLE END"
oracle("x2_binned_contributions", f"""
SELECT stay_id, l_linenumber, t.feature, value, level_label AS active_level,
  {COEF} AS coefficient, {COEF} AS contribution_logodds
FROM all_long t JOIN levels l ON l.feature = t.feature
  AND {HIT.format(v='coalesce(t.value, impute_median)')} WHERE split = 'test'""", 6,
       "value coefficient contribution_logodds")
# --- sheets --------------------------------------------------------------------------------------
cte("terms", """
SELECT p.*, m.mean, m.scale, CASE p.feature WHEN 'quantity' THEN 0.8::DOUBLE WHEN 'price'
  THEN -0.5::DOUBLE WHEN 'discount' THEN 0.25::DOUBLE WHEN 'tax' THEN 0.1::DOUBLE
  ELSE -0.3::DOUBLE END AS coefficient
FROM profile p JOIN (
  SELECT t.feature, avg(coalesce(value, impute_median)) AS mean,
    stddev_pop(coalesce(value, impute_median)) AS scale
  FROM tlong t JOIN profile USING (feature) GROUP BY 1) m ON m.feature = p.feature""")
oracle("x4_linear_sheet", """
SELECT feature, kind, coefficient AS coefficient_per_sd, exp(coefficient) AS odds_ratio_per_sd,
  coefficient / scale AS logodds_per_unit, exp(coefficient / scale) AS odds_ratio_per_unit,
  impute_median, mean AS train_mean, scale AS train_sd, q10, q25, q50 AS median, q75, q90,
  0.1::DOUBLE AS "selected_C", CAST(round_even(coefficient / (SELECT min(abs(coefficient))
    FROM terms WHERE coefficient <> 0), 0) AS INTEGER) AS points_per_sd FROM terms""", 6,
       "coefficient_per_sd odds_ratio_per_sd logodds_per_unit odds_ratio_per_unit impute_median "
       "train_mean train_sd q10 q25 median q75 q90")
cte("anchors", """
SELECT feature, kind, anchor, v, q50, coefficient, mean, scale FROM terms, LATERAL (VALUES
  (0, 'Q25', q25, 'continuous'), (1, 'Median', q50, 'continuous'), (2, 'Q75', q75, 'continuous'),
  (3, 'Q90', q90, 'continuous'), (0, '0 / absent', 0.0::DOUBLE, 'binary'),
  (1, '1 / present', 1.0::DOUBLE, 'binary')) AS a(i, anchor, v, k)
WHERE k = kind QUALIFY row_number() OVER (PARTITION BY feature, round(v, 8) ORDER BY i) = 1""")
cte("anchor_delta", """
SELECT *, coefficient * ((v - mean) / scale - (q50 - mean) / scale) AS d FROM anchors""")
oracle("x4_linear_points", """
SELECT feature, kind, anchor, v AS representative_value, q50 AS baseline_value,
  d AS delta_logodds_vs_median, CAST(round_even(d / (SELECT min(abs(d)) FROM anchor_delta
    WHERE d <> 0), 0) AS INTEGER) AS points_vs_median FROM anchor_delta""", 6,
       "representative_value baseline_value delta_logodds_vs_median")
cte("coded", f"SELECT *, {COEF} AS coef FROM bins")
cte("sheet", """
SELECT feature, kind, level_label, range_display, lower_bound, upper_bound, reference,
  coef AS coefficient_logodds_vs_reference, exp(coef) AS odds_ratio_vs_reference, train_n,
  train_events, train_event_rate, CASE WHEN reference THEN 0 ELSE CAST(round_even(coef /
    (SELECT min(abs(coef)) FROM coded WHERE NOT reference AND coef <> 0), 0) AS INTEGER) END
    AS points_vs_reference FROM coded""")
cte("sheet_top", "SELECT feature, max(abs(points_vs_reference)) AS top FROM sheet GROUP BY 1")
oracle("x5_binned_sheet", """
SELECT s.*, CAST(row_number() OVER (ORDER BY top DESC, s.feature, reference DESC,
  points_vs_reference DESC, level_label) AS INTEGER) AS sheet_position
FROM sheet s JOIN sheet_top t ON t.feature = s.feature""", 6,
       "lower_bound upper_bound coefficient_logodds_vs_reference odds_ratio_vs_reference "
       "train_event_rate")
oracle("x6_sheet_summary", """
SELECT feature, kind, count(*) AS n_levels, max(level_label) FILTER (reference) AS reference_level,
  max(abs(coefficient_logodds_vs_reference)) AS max_abs_logodds,
  max(abs(points_vs_reference)) AS max_abs_points, min(train_n) AS min_train_n,
  max(train_n) AS max_train_n, max(train_event_rate) AS max_train_event_rate,
  0.3::DOUBLE AS "selected_C" FROM sheet GROUP BY 1, 2""", 6,
       "max_abs_logodds max_train_event_rate")
# --- cases ---------------------------------------------------------------------------------------
NAMES = ("creatinine_max_24h", "map_mean_12h", "loop_diuretic_24h", "fluid_input_ml_12h",
         "glucose_std_24h", "age")
_items = ", ".join(f"({j}, '{n}')" for j, n in enumerate(NAMES))


def contrib(step: int) -> str:
    return f"""
SELECT stay_id, subject_id, ts AS landmark_time, feature,
  ((event_id * {step} + j * 13) % 5 - 2) * 0.1::DOUBLE AS c
FROM ev, (VALUES {_items}) AS f(j, feature)"""


cte("con3", contrib(3))
cte("con7", contrib(7))
oracle("x8_term_overlap", """
SELECT b.stay_id, b.subject_id, b.landmark_time,
  string_agg(b.feature, ',' ORDER BY abs(b.c) DESC, b.feature) AS overlap_terms,
  count(*) AS overlap_count
FROM con7 b JOIN con3 a ON a.stay_id = b.stay_id AND a.subject_id = b.subject_id
 AND a.landmark_time = b.landmark_time AND a.feature = b.feature
WHERE abs(b.c) > 1e-9 AND abs(a.c) > 0.15 GROUP BY 1, 2, 3""")
cte("escore", """
SELECT stay_id, subject_id, ts AS landmark_time, hour(ts) AS h, value / 500.0 AS p,
  event_id % 3 AS n_missing, (hour(ts) * 60 + minute(ts) + 1) / 1500.0 AS pr
FROM ev WHERE event_type = 'purchase'""")
cte("targets", """
SELECT quantile_cont(p, 0.85) AS tp, quantile_cont(pr::DOUBLE, 0.85) AS tr FROM escore""")
cte("near_one", """
SELECT 'alone' AS kind, stay_id, landmark_time, tp AS target_p, abs(p - tp) AS distance_to_target,
  NULL::DOUBLE AS agreement_gap,
  row_number() OVER (ORDER BY abs(p - tp), n_missing, p DESC, h, subject_id, stay_id,
                     landmark_time) AS case_rank FROM escore, targets""")
cte("near_two", """
SELECT 'with reference' AS kind, stay_id, subject_id, landmark_time, tp AS target_p,
  abs(p - tp) + 0.75 * abs(pr - tr) AS distance_to_target, abs(p - pr) AS agreement_gap,
  n_missing, p, h,
  row_number() OVER (ORDER BY abs(p - tp) + 0.75 * abs(pr - tr), abs(p - pr), n_missing, p DESC,
                     h, subject_id, stay_id, landmark_time) AS case_rank FROM escore, targets""")
oracle("k5_rank_cases", """
SELECT kind, stay_id, landmark_time, target_p, distance_to_target, agreement_gap, case_rank
FROM near_one WHERE case_rank <= 10
UNION ALL SELECT kind, stay_id, landmark_time, target_p, distance_to_target, agreement_gap,
  case_rank FROM near_two WHERE case_rank <= 10""", 6,
       "target_p distance_to_target agreement_gap")
cte("case_hits", """
SELECT stay_id, subject_id, landmark_time, count(*) AS nonzero_terms,
  count(*) FILTER (feature IN ('creatinine_max_24h', 'map_mean_12h', 'loop_diuretic_24h'))
    AS priority_hits,
  count(*) FILTER (feature IN ('fluid_input_ml_12h', 'glucose_std_24h', 'age')) AS context_hits,
  bool_or(feature = 'creatinine_max_24h') AS renal_hit,
  bool_or(feature = 'map_mean_12h') AS hemodynamic_hit,
  string_agg(feature, ',' ORDER BY abs(c) DESC, feature) AS active_terms
FROM con7 WHERE abs(c) > 1e-9 GROUP BY 1, 2, 3""")
oracle("k6_rerank_cases", """
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY priority_hits DESC, renal_hit DESC, hemodynamic_hit DESC,
      nonzero_terms DESC, context_hits DESC, distance_to_target, agreement_gap, n_missing,
      p DESC, h, n.subject_id, n.stay_id, n.landmark_time) AS case_rank,
    n.stay_id, n.landmark_time, priority_hits, nonzero_terms, context_hits, renal_hit,
    hemodynamic_hit, active_terms, distance_to_target,
    'primary_plus_bedside_legibility' AS selection_strategy
  FROM near_two n JOIN case_hits c ON c.stay_id = n.stay_id AND c.landmark_time = n.landmark_time
  WHERE n.case_rank <= 200)
WHERE case_rank <= 10""", 6, "distance_to_target")
