"""Oracles for features, cohort, labels, splits and QA."""

from __future__ import annotations

from oracles import core as _core  # noqa: F401  (defines the CTEs used here)
from oracles.base import assemble, cte

ORACLES = {}


def oracle(name: str, sql: str, digits: int | None = None, doubles: str = "") -> None:
    if doubles:
        cols = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles.split())
        sql = f"SELECT * REPLACE ({cols}) FROM (\n{sql.strip()}\n) AS q"
    ORACLES[name] = assemble(sql)


LATEST = "arg_max(value, (t, value))"
EARLIEST = "arg_min(value, (t, value))"


def rolling(lm: str, events: str, windows: str = "(6), (12), (24)") -> str:
    """Range join of landmarks, windows and events; ties by larger / smaller value."""
    return f"""
SELECT l.stay_id, l.landmark_time, w AS window_h, feature_name, min(t) AS earliest_event_time,
  max(t) AS latest_event_time, count(value) AS n_count, avg(value) AS mean_val,
  stddev_samp(value) AS std_val, min(value) AS min_val, max(value) AS max_val,
  {LATEST} AS latest_val, {EARLIEST} AS earliest_val, {LATEST} - {EARLIEST} AS delta_val
FROM {lm} l, (VALUES {windows}) AS v(w), {events} e
WHERE e.stay_id = l.stay_id AND t <= l.landmark_time AND t > l.landmark_time - to_hours(w)
GROUP BY ALL"""


STATS = "mean_val std_val min_val max_val latest_val earliest_val delta_val"
cte("all_signals", "SELECT stay_id, event_type AS feature_name, ts AS t, value FROM ev")
cte("all_rolling", rolling("stay_lm", "all_signals"))
oracle("a5_rolling_features", "SELECT * FROM all_rolling", 9, STATS)
# --- cohort ------------------------------------------------------------------------------
cte("prevalent", """
SELECT b.stay_id FROM base_cohort b JOIN onset o ON o.stay_id = b.stay_id
WHERE date_diff('microsecond', intime + INTERVAL 24 HOUR, onset_stage1_time) <= 0""")
cte("members", """
SELECT b.*, CASE WHEN age >= 85 THEN '85+' WHEN age >= 65 THEN '65-84' WHEN age >= 45
  THEN '45-64' ELSE '18-44' END AS age_group FROM base_cohort b
WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.subject_id = b.subject_id)
  AND NOT EXISTS (SELECT 1 FROM prevalent x WHERE x.stay_id = b.stay_id)""")
cte("lm_all", """
SELECT stay_id, subject_id, hadm_id, anchor_year_group, age, age_group, sex, ethnicity, intime,
  outtime, intime + to_hours(24 + 6 * k) AS landmark_time
FROM members, (SELECT unnest(range(0, 130)) AS k)
WHERE intime + to_hours(24 + 6 * k) <= outtime - INTERVAL 48 HOUR
  AND outtime - intime >= INTERVAL 30 HOUR""")
cte("lm", """
SELECT l.*, onset_stage1_time, onset_stage2_time, onset_stage3_time,
  date_diff('hour', intime, landmark_time) AS hours_since_icu_admit
FROM lm_all l JOIN onset o ON o.stay_id = l.stay_id
WHERE onset_stage1_time IS NULL OR onset_stage1_time > landmark_time""")
oracle("c2_cohort", "SELECT * EXCLUDE (dod, deathtime) FROM members", 6, "los")
oracle("c2_cohort_landmarks", "SELECT * FROM lm")
oracle("c6_prevalent_onset", "SELECT stay_id FROM prevalent")


def onset_label(stage: int, h: int) -> str:
    return (f"coalesce(CAST(onset_stage{stage}_time > landmark_time AND onset_stage{stage}_time "
            f"- landmark_time <= INTERVAL {h} HOUR AS INTEGER), 0) AS y_stage{stage}_{h}h")


def seen_label(h: int, lm: str = "l") -> str:
    return (f"CAST(EXISTS (SELECT 1 FROM cr_stages k WHERE k.stay_id = {lm}.stay_id AND "
            f"k.kdigo_cr_stage > 0 AND k.charttime > {lm}.landmark_time AND k.charttime <= "
            f"{lm}.landmark_time + INTERVAL {h} HOUR) AS INTEGER) AS y_cr_only_stage1_{h}h")


MAIN = ", ".join(onset_label(s, h) for s in (1, 2) for h in (24, 48))
SEEN = ", ".join(seen_label(h) for h in (24, 48))
oracle("a9_horizon_labels", f"""
SELECT l.stay_id, l.subject_id, landmark_time, {MAIN}
FROM stay_lm l JOIN onset o ON o.stay_id = l.stay_id""")
oracle("a10_event_labels", f"SELECT stay_id, landmark_time, {SEEN} FROM stay_lm l")
cte("labels_", f"SELECT stay_id, subject_id, landmark_time, {MAIN}, {SEEN} FROM lm l")
oracle("c3_labels", "SELECT * FROM labels_")
# --- numeric events and rolling on the cohort --------------------------------------------------
cte("raw_numeric", """
SELECT stay_id, charttime AS t, itemid, 'chartevents' AS source, valuenum FROM chartevents
UNION ALL
SELECT m.stay_id, charttime, itemid, 'labevents', valuenum
FROM labevents l JOIN members m ON m.hadm_id = l.hadm_id""")
cte("numeric_ev", """
SELECT stay_id, t, feature_name, (valuenum + unit_offset) * unit_multiplier AS value
FROM raw_numeric r JOIN signals s ON s.source = r.source AND s.itemid = r.itemid
WHERE (valuenum + unit_offset) * unit_multiplier BETWEEN valid_low AND valid_high""")
cte("lm_rolling", rolling("lm", "numeric_ev"))
oracle("a5_numeric_events", "SELECT * FROM numeric_ev", 9, "value")
oracle("a5_cohort_rolling", "SELECT * FROM lm_rolling", 9, STATS)
oracle("w4_latest_earliest", """
SELECT DISTINCT l.stay_id, landmark_time, event_type AS feature_name,
  first_value(value) OVER (PARTITION BY l.stay_id, landmark_time, event_type
                           ORDER BY ts DESC, value DESC) AS latest_val,
  first_value(value) OVER (PARTITION BY l.stay_id, landmark_time, event_type
                           ORDER BY ts, value) AS earliest_val,
  latest_val - earliest_val AS delta_val
FROM stay_lm l JOIN ev ON ev.stay_id = l.stay_id AND ts <= landmark_time
 AND ts > landmark_time - INTERVAL 24 HOUR""", 9, "latest_val earliest_val delta_val")
# --- exposure ----------------------------------------------------------------------------------
NET = "CASE WHEN itemid = 227488 THEN -value ELSE value END"


def treatments(lm: str) -> str:
    fluid = ", ".join(
        f"(SELECT sum(amount) FROM inputevents i WHERE i.stay_id = l.stay_id AND lower(amountuom) "
        f"= 'ml' AND starttime BETWEEN l.landmark_time - INTERVAL {w} HOUR AND l.landmark_time) "
        f"AS fluid_input_ml_{w}h" for w in (6, 12, 24))
    urine = ", ".join(
        f"greatest(0, coalesce((SELECT sum({NET}) FROM outputevents o WHERE o.stay_id = l.stay_id "
        f"AND charttime BETWEEN l.landmark_time - INTERVAL {w} HOUR AND l.landmark_time), 0)) "
        f"AS urine_output_ml_{w}h" for w in (6, 12, 24))
    return f"""
SELECT l.stay_id, l.landmark_time,
  CAST(EXISTS (SELECT 1 FROM inputevents i WHERE i.stay_id = l.stay_id
    AND itemid IN (221906, 222315) AND starttime <= l.landmark_time
    AND endtime > l.landmark_time - INTERVAL 24 HOUR) AS INTEGER) AS vasopressor_any_24h,
  CAST(EXISTS (SELECT 1 FROM inputevents i WHERE i.stay_id = l.stay_id AND itemid = 221794
    AND starttime BETWEEN l.landmark_time - INTERVAL 24 HOUR AND l.landmark_time) AS INTEGER)
    AS loop_diuretic_24h,
  CAST(EXISTS (SELECT 1 FROM chartevents c WHERE c.stay_id = l.stay_id AND itemid = 225792
    AND charttime BETWEEN l.landmark_time - INTERVAL 24 HOUR AND l.landmark_time) AS INTEGER)
    AS mech_vent_24h, {fluid}, {urine}
FROM {lm} l"""


SUMS = " ".join(f"{p}_{w}h" for p in ("fluid_input_ml", "urine_output_ml") for w in (6, 12, 24))
cte("stay_treat", treatments("stay_lm"))
cte("lm_treat", treatments("lm"))
oracle("a6_exposure_flags", """
SELECT stay_id, landmark_time, vasopressor_any_24h, loop_diuretic_24h, mech_vent_24h
FROM stay_treat""")
oracle("a7_exposure_sums", f"SELECT stay_id, landmark_time, {SUMS.replace(' ', ', ')} "
       "FROM stay_treat", 6, SUMS)
oracle("a8_treatment_block", "SELECT * FROM lm_treat", 6, SUMS)
# --- matrix --------------------------------------------------------------------------------------
oracle("g6_melt", """
SELECT stay_id, landmark_time, window_h, feature_name, agg, val FROM (
  SELECT stay_id, landmark_time, window_h, feature_name, latest_val AS latest, delta_val AS delta,
    min_val AS min, max_val AS max, mean_val AS mean, std_val AS std, n_count::DOUBLE AS count
  FROM all_rolling WHERE window_h <> 12)
UNPIVOT INCLUDE NULLS (val FOR agg IN (latest, delta, min, max, mean, std, count))""", 9, "val")


def cell(rel: str, feature: str, agg: str, w: int) -> str:
    col = "n_count" if agg == "count" else f"{agg}_val"
    return (f"(SELECT {col} FROM {rel} r WHERE r.stay_id = l.stay_id AND r.landmark_time = "
            f"l.landmark_time AND r.feature_name = '{feature}' AND r.window_h = {w}) "
            f"AS {feature}_{agg}_{w}h")


AGGS = ("latest", "delta", "min", "max", "mean", "std", "count")
PIVOT = [(f, a, w) for f in ("click", "purchase", "refund") for w in (6, 24) for a in AGGS]
oracle("g7_pivot", "SELECT l.stay_id, l.landmark_time, " + ",\n ".join(
    f"max({'n_count' if a == 'count' else a + '_val'}) FILTER (feature_name = '{f}' AND "
    f"window_h = {w}) AS {f}_{a}_{w}h" for f, a, w in PIVOT) +
    " FROM stay_lm l JOIN all_rolling r ON r.stay_id = l.stay_id AND r.landmark_time = "
    "l.landmark_time AND window_h <> 12 GROUP BY 1, 2", 9,
    " ".join(f"{f}_{a}_{w}h" for f, a, w in PIVOT if a != "count"))
oracle("p16_missing_flags", "SELECT l.stay_id, l.landmark_time, " + ",\n ".join(
    f"max(n_count) FILTER (feature_name = '{f}' AND window_h = {w}) AS {f}_count_{w}h, "
    f"CAST(count(*) FILTER (feature_name = '{f}' AND window_h = {w}) = 0 AS INTEGER) "
    f"AS {f}_missing_{w}h" for f in ("click", "view") for w in (6, 24)) +
    " FROM stay_lm l LEFT JOIN all_rolling r ON r.stay_id = l.stay_id AND r.landmark_time = "
    "l.landmark_time GROUP BY 1, 2")


def wide(cells) -> str:
    """Wide statistics of the cohort: one conditional aggregate per cell."""
    out = []
    for f, a, w in cells:
        hit = f"FILTER (feature_name = '{f}' AND window_h = {w})"
        if a == "missing":
            out.append(f"CAST(count(*) {hit} = 0 AS INTEGER) AS {f}_missing_{w}h")
        else:
            out.append(f"max({'n_count' if a == 'count' else a + '_val'}) {hit} AS {f}_{a}_{w}h")
    return ",\n  ".join(out)


CELLS = [("heart_rate", "mean", 24), ("heart_rate", "missing", 24), ("map", "latest", 6),
         ("map", "count", 12), ("map", "missing", 6), ("map", "mean", 12),
         ("temperature_c", "std", 24), ("creatinine", "max", 24), ("creatinine", "delta", 24),
         ("glucose", "min", 12), ("glucose", "missing", 12), ("glucose", "std", 24),
         ("hematocrit", "max", 24), ("sodium", "mean", 6), ("sodium", "missing", 24)]
cte("lm_wide", f"""
SELECT l.stay_id, l.landmark_time, {wide(CELLS)}
FROM lm l LEFT JOIN lm_rolling r ON r.stay_id = l.stay_id AND r.landmark_time = l.landmark_time
GROUP BY 1, 2""")
RACES = {"White": "MACHINERY", "Black": "BUILDING", "Hispanic": "AUTOMOBILE",
         "Asian": "FURNITURE", "Other": "HOUSEHOLD"}
cte("full_matrix", """
SELECT l.*, CAST(sex = 'M' AS INTEGER) AS sex_male, """ + ", ".join(
    f"CAST(ethnicity = '{r}' AS INTEGER) AS eth_{g}" for g, r in RACES.items()) + """,
  w.* EXCLUDE (stay_id, landmark_time), t.* EXCLUDE (stay_id, landmark_time),
  y.* EXCLUDE (stay_id, subject_id, landmark_time)
FROM lm l JOIN lm_wide w ON w.stay_id = l.stay_id AND w.landmark_time = l.landmark_time
JOIN lm_treat t ON t.stay_id = l.stay_id AND t.landmark_time = l.landmark_time
JOIN labels_ y ON y.stay_id = l.stay_id AND y.landmark_time = l.landmark_time""")
oracle("g8_feature_matrix", """
SELECT stay_id, landmark_time, age, sex_male, eth_White, eth_Black, eth_Hispanic, eth_Asian,
  eth_Other, heart_rate_mean_24h, heart_rate_missing_24h, map_latest_6h, map_count_12h,
  map_missing_6h, temperature_c_std_24h, creatinine_max_24h, creatinine_delta_24h,
  glucose_min_12h, glucose_missing_12h, sodium_mean_6h, sodium_missing_24h, vasopressor_any_24h,
  fluid_input_ml_12h, urine_output_ml_6h, y_stage1_24h, y_stage2_48h, y_cr_only_stage1_48h
FROM full_matrix""", 6, "heart_rate_mean_24h map_latest_6h temperature_c_std_24h "
       "creatinine_max_24h creatinine_delta_24h glucose_min_12h sodium_mean_6h "
       "fluid_input_ml_12h urine_output_ml_6h")
oracle("p13_group_category", """
SELECT hadm_id, race, CASE race WHEN 'MACHINERY' THEN 'White' WHEN 'BUILDING' THEN 'Black'
  WHEN 'AUTOMOBILE' THEN 'Hispanic' WHEN 'FURNITURE' THEN 'Asian' ELSE 'Other' END
  AS ethnicity_group FROM admissions""")
oracle("p14_binary_encode", "SELECT subject_id, CAST(gender = 'M' AS INTEGER) AS sex_male "
       "FROM patients")
oracle("p15_one_hot", "SELECT hadm_id, " + ", ".join(
    f"CAST(race = '{r}' AS INTEGER) AS eth_{g}" for g, r in RACES.items()) + " FROM admissions")
META = ("stay_id, subject_id, landmark_time, anchor_year_group, age, age_group, sex, ethnicity, "
        "hours_since_icu_admit")
YS = ("y_stage1_24h, y_stage1_48h, y_stage2_24h, y_stage2_48h, y_cr_only_stage1_24h, "
      "y_cr_only_stage1_48h")
oracle("p17_feature_family", f"""
SELECT {META}, {YS}, creatinine_max_24h, map_mean_12h, loop_diuretic_24h, fluid_input_ml_12h,
  glucose_std_24h FROM full_matrix""", 6,
       "creatinine_max_24h map_mean_12h fluid_input_ml_12h glucose_std_24h")
oracle("c4_features", f"""
SELECT {META}, {YS}, urine_output_ml_6h, creatinine_max_24h, map_mean_12h, hematocrit_max_24h,
  loop_diuretic_24h, fluid_input_ml_12h, glucose_std_24h FROM full_matrix""", 6,
       "urine_output_ml_6h creatinine_max_24h map_mean_12h hematocrit_max_24h "
       "fluid_input_ml_12h glucose_std_24h")
oracle("p18_feature_columns", """
SELECT stay_id, landmark_time, age, urine_output_ml_6h, creatinine_max_24h, map_mean_12h,
  hematocrit_max_24h FROM full_matrix""", 6,
       "urine_output_ml_6h creatinine_max_24h map_mean_12h hematocrit_max_24h")
oracle("p19_task_labels", " UNION ALL ".join(
    f"SELECT 'aki_stage{s}_{h}h' AS task, CAST(sum(y_stage{s}_{h}h) AS BIGINT) AS n_pos, "
    f"count(*) AS n FROM labels_" for s in (1, 2) for h in (24, 48)))
SPLIT = """CASE WHEN anchor_year_group IN ('2008 - 2010', '2011 - 2013') THEN 'train'
  WHEN anchor_year_group = '2014 - 2016' THEN 'val'
  WHEN anchor_year_group IN ('2017 - 2019', '2020 - 2022') THEN 'test' END"""
cte("split_matrix", f"SELECT *, {SPLIT} AS split FROM full_matrix "
    "WHERE anchor_year_group <> '2005 - 2007'")
oracle("p20_labelled_rows", """
SELECT stay_id, subject_id, landmark_time, split, age, creatinine_max_24h, y_stage1_24h
FROM split_matrix WHERE NOT (y_stage1_24h = 1 AND sex = 'M')""", 6, "creatinine_max_24h")
# --- importance ---------------------------------------------------------------------------------
cte("imp", """
SELECT 'aki_stage' || (l_linenumber % 2 + 1) || CASE WHEN l_suppkey % 2 = 0 THEN '_24h'
    ELSE '_48h' END AS task, 'combined' AS family, 'additive' AS model,
  'f' || (l_partkey % 30) || CASE WHEN l_partkey % 10 = 0 THEN ' x f1' ELSE '' END AS term,
  round(sum(l_discount - l_tax) / 100.0, 6) AS importance FROM lineitem GROUP BY ALL""")
cte("ranked", """
SELECT task, family, model, term AS feature, abs(importance) AS abs_importance,
  row_number() OVER (PARTITION BY task, family, model ORDER BY abs(importance) DESC, term) AS rank
FROM imp WHERE NOT contains(term, ' x ') AND NOT contains(term, '&')""")
cte("rollup_", """
SELECT feature, avg(abs_importance) AS mean_abs_importance,
  max(abs_importance) AS max_abs_importance, count(DISTINCT task) AS n_artifacts,
  min(rank) AS best_rank FROM ranked GROUP BY feature""")
oracle("w6_rank_terms", "SELECT * FROM ranked", 6, "abs_importance")
oracle("p21_select_results", "SELECT * FROM ranked WHERE task = 'aki_stage1_24h' "
       "OR task = 'aki_stage2_48h'", 6, "abs_importance")
oracle("a15_importance_rollup", "SELECT * FROM rollup_", 6,
       "mean_abs_importance max_abs_importance")
oracle("k4_minimal_selection", """
SELECT r.*, n <= 10 AS selected, CASE WHEN n <= 10 THEN n END AS selected_rank,
  'combined' AS source_family
FROM (SELECT *, row_number() OVER (ORDER BY mean_abs_importance DESC, n_artifacts DESC,
        best_rank, feature) AS n FROM rollup_) x JOIN rollup_ r ON r.feature = x.feature""",
       6, "mean_abs_importance max_abs_importance")
_cand = ("creatinine_max_24h", "map_mean_12h", "glucose_std_24h", "fluid_input_ml_12h",
         "urine_output_ml_6h")
cte("minimal_long", " UNION ALL ".join(
    f"SELECT stay_id, landmark_time, '{f}' AS feature, {f}::DOUBLE AS value, y_stage1_24h "
    f"FROM full_matrix" for f in _cand))
oracle("k4_minimal_family", """
SELECT stay_id, landmark_time, feature, value FROM minimal_long WHERE feature IN (
  SELECT feature FROM minimal_long GROUP BY feature
  ORDER BY abs(avg(value) FILTER (y_stage1_24h = 1)) DESC NULLS LAST, feature LIMIT 3)""", 6,
       "value")
# --- summaries -----------------------------------------------------------------------------------
oracle("a11_entity_counts", """
SELECT count(*) AS n_rows, count(DISTINCT stay_id) AS n_stays,
  count(DISTINCT subject_id) AS n_patients, count(DISTINCT hadm_id) AS n_admissions FROM stay_lm""")
oracle("a12_landmark_summary", """
SELECT count(*) AS n_landmarks, count(DISTINCT stay_id) AS n_stays,
  count(DISTINCT subject_id) AS n_patients,
  round(avg(hours_since_icu_admit), 1) AS mean_hours_since_icu_admit,
  median(hours_since_icu_admit) AS median_hours_since_icu_admit,
  round(count(onset_stage1_time) / count(*), 4) AS share_with_stage1_onset_recorded FROM lm""")
oracle("a13_landmarks_per_episode", """
SELECT stay_id, subject_id, count(*) AS n_landmarks,
  min(hours_since_icu_admit) AS first_landmark_hour,
  max(hours_since_icu_admit) AS last_landmark_hour
FROM lm GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 20""")
oracle("a14_split_manifest", f"""
SELECT {SPLIT} AS split, count(*) AS n_rows, count(DISTINCT stay_id) AS n_stays,
  count(DISTINCT subject_id) AS n_patients FROM lm WHERE split IS NOT NULL GROUP BY 1""")
oracle("k1_preview", "SELECT * FROM lm ORDER BY subject_id, stay_id, landmark_time LIMIT 20")
oracle("k2_landmark_preview", """
SELECT l.subject_id, l.stay_id, anchor_year_group, age, sex, ethnicity, intime, l.landmark_time,
  hours_since_icu_admit, onset_stage1_time, onset_stage2_time,
  date_diff('hour', l.landmark_time, onset_stage1_time) AS hours_to_stage1_onset,
  date_diff('hour', l.landmark_time, onset_stage2_time) AS hours_to_stage2_onset,
  y_stage1_24h, y_stage1_48h, y_stage2_24h, y_stage2_48h
FROM lm l LEFT JOIN labels_ y ON y.stay_id = l.stay_id AND y.landmark_time = l.landmark_time
ORDER BY 1, 2, 8 LIMIT 20""")
# --- QA, splits, drift ---------------------------------------------------------------------------
cte("qa_c", """
SELECT count(*) AS n_stays, count(DISTINCT subject_id) AS n_patients,
  count(DISTINCT hadm_id) AS n_admissions, min(age) AS min_age, max(age) AS max_age,
  avg(age) AS mean_age, count(*) FILTER (sex = 'F') AS n_female,
  min(anchor_year_group) AS earliest_year_group, max(anchor_year_group) AS latest_year_group
FROM members""")
oracle("q1_qa_cohort", "SELECT * FROM qa_c", 6, "mean_age")
cte("qa_l", """
SELECT count(*) AS n_landmarks, count(DISTINCT stay_id) AS n_stays_with_landmarks,
  count(DISTINCT subject_id) AS n_patients_with_landmarks,
  avg(hours_since_icu_admit) AS mean_hours_since_admit,
  max(hours_since_icu_admit) AS max_hours_since_admit FROM lm""")
oracle("q2_qa_landmarks", "SELECT * FROM qa_l", 6, "mean_hours_since_admit")
cte("qa_y", """
SELECT count(*) AS n_landmarks, avg(y_stage1_24h) AS prev_stage1_24h,
  avg(y_stage1_48h) AS prev_stage1_48h, avg(y_stage2_24h) AS prev_stage2_24h,
  avg(y_stage2_48h) AS prev_stage2_48h, avg(y_cr_only_stage1_24h) AS prev_cr_only_24h,
  avg(y_cr_only_stage1_48h) AS prev_cr_only_48h FROM labels_""")
PREVS = ("prev_stage1_24h", "prev_stage1_48h", "prev_stage2_24h", "prev_stage2_48h",
         "prev_cr_only_24h", "prev_cr_only_48h")
oracle("q3_qa_prevalence", "SELECT * FROM qa_y", 9, " ".join(PREVS))


def leakage(rel: str) -> str:
    return f"""
SELECT count(*) AS n_rolling_rows,
  count(*) FILTER (latest_event_time > landmark_time) AS n_future_feature_rows,
  count(*) FILTER (earliest_event_time <= landmark_time - to_hours(window_h))
    AS n_before_window_feature_rows,
  max(epoch_us(latest_event_time) - epoch_us(landmark_time)) AS max_future_offset_us FROM {rel}"""


oracle("q4_qa_leakage", leakage("all_rolling"))
COVER = """SELECT count(*) AS n_stays, nullif(count(baseline_mg_dl), 0) AS n_with_baseline,
  nullif(count(baseline_7d), 0) AS n_7d_baseline, nullif(count(baseline_365d), 0)
  AS n_365d_baseline """
oracle("q5_qa_coverage", COVER + "FROM baselines")
oracle("q6_qa_cohort_coverage", COVER + "FROM members m LEFT JOIN baselines b "
       "ON b.stay_id = m.stay_id")
cte("qa_k", leakage("lm_rolling"))
RULES = [("cohort is not empty", "c.n_stays", "{} > 0"),
         ("cohort has patients", "c.n_patients", "{} > 0"),
         ("minimum age holds", "c.min_age", "{} >= 18"),
         ("landmarks are not empty", "l.n_landmarks", "{} > 0"),
         ("stays have landmarks", "l.n_stays_with_landmarks", "{} > 0"),
         ("labels are not empty", "y.n_landmarks", "{} > 0")]
RULES += [(f"{p} within [0, 1]", f"y.{p}", "{} BETWEEN 0 AND 1") for p in PREVS]
RULES += [(f"stage{s} 48h prevalence is at least 24h",
           f"y.prev_stage{s}_48h - y.prev_stage{s}_24h", "{} >= 0") for s in (1, 2)]
RULES += [(f"stage2 {h}h prevalence is at most stage1",
           f"y.prev_stage1_{h}h - y.prev_stage2_{h}h", "{} >= 0") for h in (24, 48)]
RULES += [("rolling features are not empty", "k.n_rolling_rows", "{} > 0"),
          ("no events after landmark_time", "k.n_future_feature_rows", "{} = 0"),
          ("no events before the window", "k.n_before_window_feature_rows", "{} = 0"),
          ("baseline rows match the cohort", "(SELECT count(*) FROM members) - c.n_stays",
           "{} = 0")]
oracle("q7_invariants", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST({v} AS DOUBLE) AS value, {t.format('(' + v + ')')} AS ok "
    f"FROM qa_c c, qa_l l, qa_y y, qa_k k" for n, v, t in RULES), 9, "value")
oracle("q8_assign_splits", f"SELECT subject_id, anchor_year_group, {SPLIT} AS split FROM patients "
       "WHERE split IS NOT NULL")
oracle("q9_exclusive_check", f"""
SELECT subject_id, count(DISTINCT {SPLIT}) AS n_splits FROM lm GROUP BY 1 HAVING n_splits > 1""")
oracle("q10_load_split", f"SELECT stay_id, subject_id, landmark_time, {SPLIT} AS split FROM lm "
       "WHERE split = 'test'")
oracle("q11_group_kfold", """
SELECT l_orderkey, l_linenumber, s.subject_id, fold FROM scored s JOIN (
  WITH RECURSIVE sizes AS (
    SELECT subject_id, size, row_number() OVER (ORDER BY size DESC,
      substr(md5(subject_id::VARCHAR), 1, 2), subject_id) AS n
    FROM (SELECT subject_id, count(*) AS size FROM scored WHERE split = 'train' GROUP BY 1)),
  pack(n, subject_id, fold, loads) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0, 0]::BIGINT[]
    UNION ALL
    SELECT z.n, z.subject_id, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
      [CASE WHEN i = list_position(loads, list_min(loads)) THEN loads[i] + size ELSE loads[i] END
       FOR i IN range(1, 6)]
    FROM pack p JOIN sizes z ON z.n = p.n + 1)
  SELECT subject_id, fold FROM pack WHERE n > 0) r
ON r.subject_id = s.subject_id WHERE split = 'train'""")
oracle("u3_split_overlap", """
SELECT subject_id, count(DISTINCT split) AS n_splits FROM scored GROUP BY 1
HAVING min(split) <> max(split)""")
oracle("q12_split_prevalence", f"""
SELECT {SPLIT} AS split, count(*) AS n_rows, count(DISTINCT y.stay_id) AS n_stays,
  count(DISTINCT y.subject_id) AS n_patients, """ + ", ".join(
    f"avg({y.strip()}) AS prev_{y.strip()}" for y in YS.split(",")) + """
FROM labels_ y JOIN members m ON m.stay_id = y.stay_id WHERE split IS NOT NULL GROUP BY 1""",
       9, " ".join(f"prev_{y.strip()}" for y in YS.split(",")))


def drift(rel: str, names, flagged: bool) -> str:
    flag = ", abs(smd) > 0.1 AS flagged" if flagged else ""
    parts = [f"""
SELECT '{f}' AS feature, s.split, t.n AS n_train, s.n AS n_split, t.m AS mean_train,
  s.m AS mean_split, CASE WHEN t.sd * t.sd + s.sd * s.sd > 0
    THEN (s.m - t.m) / sqrt((t.sd * t.sd + s.sd * s.sd) / 2) ELSE 0 END AS smd,
  abs(smd) AS abs_smd, t.miss AS missing_rate_train, s.miss AS missing_rate_split{flag}
FROM (SELECT count({f}) AS n, avg({f}) AS m, stddev_samp({f}) AS sd,
        1 - count({f}) / count(*) AS miss FROM {rel} WHERE split = 'train') t,
     (SELECT split, count({f}) AS n, avg({f}) AS m, stddev_samp({f}) AS sd,
        1 - count({f}) / count(*) AS miss FROM {rel} WHERE split <> 'train' GROUP BY 1) s
WHERE t.n > 0 AND s.n > 0""" for f in names]
    return " UNION ALL ".join(parts)


DRIFT = "mean_train mean_split smd abs_smd missing_rate_train missing_rate_split"
cte("drift_rows", """
SELECT split, p, y, l_extendedprice, l_discount,
  CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS sparse,
  CASE WHEN split <> 'test' THEN l_tax END AS empty_in_test FROM scored""")
oracle("q13_feature_drift", drift("drift_rows", (
    "p", "y", "l_extendedprice", "l_discount", "sparse", "empty_in_test"), True), 6, DRIFT)
oracle("q13_matrix_drift", drift("split_matrix", (
    "age", "creatinine_max_24h", "map_mean_12h", "glucose_std_24h", "fluid_input_ml_12h",
    "urine_output_ml_6h"), False), 6, DRIFT)
