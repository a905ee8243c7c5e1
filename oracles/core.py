"""Oracles for grids, joins, windows and concepts: range joins and correlated lookups."""

from __future__ import annotations

from oracles.base import assemble, cte

ORACLES = {}

# --- fixed values: name, source, item id, valid range, multiplier, offset ------------
SIGNALS = (
  ('heart_rate', 'chartevents', 220045, 20.0, 300.0, 1.0, 0.0),
  ('sbp', 'chartevents', 220050, 40.0, 300.0, 1.0, 0.0),
  ('sbp', 'chartevents', 220179, 40.0, 300.0, 1.0, 0.0),
  ('dbp', 'chartevents', 220051, 20.0, 200.0, 1.0, 0.0),
  ('dbp', 'chartevents', 220180, 20.0, 200.0, 1.0, 0.0),
  ('map', 'chartevents', 220052, 30.0, 250.0, 1.0, 0.0),
  ('map', 'chartevents', 220181, 30.0, 250.0, 1.0, 0.0),
  ('resp_rate', 'chartevents', 220210, 4.0, 70.0, 1.0, 0.0),
  ('spo2', 'chartevents', 220277, 50.0, 100.0, 1.0, 0.0),
  ('temperature_c', 'chartevents', 223762, 30.0, 45.0, 1.0, 0.0),
  ('gcs_eye', 'chartevents', 220739, 1.0, 4.0, 1.0, 0.0),
  ('gcs_verbal', 'chartevents', 223900, 1.0, 5.0, 1.0, 0.0),
  ('gcs_motor', 'chartevents', 223901, 1.0, 6.0, 1.0, 0.0),
  ('temperature_c', 'chartevents', 223761, 30.0, 45.0, 0.5555555555555556, -32.0),
  ('creatinine', 'labevents', 50912, 0.1, 30.0, 1.0, 0.0),
  ('bun', 'labevents', 51006, 1.0, 200.0, 1.0, 0.0),
  ('potassium', 'labevents', 50971, 1.5, 10.0, 1.0, 0.0),
  ('sodium', 'labevents', 50983, 110.0, 170.0, 1.0, 0.0),
  ('bicarbonate', 'labevents', 50882, 5.0, 50.0, 1.0, 0.0),
  ('chloride', 'labevents', 50902, 70.0, 140.0, 1.0, 0.0),
  ('glucose', 'labevents', 50931, 20.0, 1000.0, 1.0, 0.0),
  ('glucose', 'labevents', 50809, 20.0, 1000.0, 1.0, 0.0),
  ('hemoglobin', 'labevents', 51222, 2.0, 25.0, 1.0, 0.0),
  ('hematocrit', 'labevents', 51221, 10.0, 70.0, 1.0, 0.0),
  ('wbc', 'labevents', 51301, 0.1, 100.0, 1.0, 0.0),
  ('platelets', 'labevents', 51265, 5.0, 1500.0, 1.0, 0.0),
  ('lactate', 'labevents', 50813, 0.1, 30.0, 1.0, 0.0),
  ('albumin', 'labevents', 50862, 0.5, 6.0, 1.0, 0.0),
  ('ph_arterial', 'labevents', 50820, 6.5, 8.0, 1.0, 0.0),
)
# --- fixed values: hash of the fixtures' configuration --------------------------------
CONFIG_HASH = "255e0693115bad8c"
# --- end of fixed values ---------------------------------------------------------------


def oracle(name: str, sql: str, digits: int | None = None, doubles: str = "") -> None:
    """Register; ``doubles`` names the columns rounded to ``digits``."""
    if doubles:
        cols = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles.split())
        sql = f"SELECT * REPLACE ({cols}) FROM (\n{sql.strip()}\n) AS q"
    ORACLES[name] = assemble(sql)


cte("signals", "SELECT * FROM (VALUES " + ",\n  ".join(
    f"('{f}', '{s}', {i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE, {m!r}::DOUBLE, {o!r}::DOUBLE)"
    for f, s, i, lo, hi, m, o in SIGNALS) +
    ") AS t(feature_name, source, itemid, valid_low, valid_high, unit_multiplier, unit_offset)")

# Item ids inside the statements below are fixed values of the source tables.
# --- concept chain -------------------------------------------------------------------
cte("weight", """
SELECT s.stay_id, coalesce(
    (SELECT avg(patientweight) FROM inputevents i
     WHERE i.stay_id = s.stay_id AND patientweight >= 30 AND patientweight <= 300),
    (SELECT avg(m) FROM (
        SELECT avg(CASE WHEN itemid = 226531 THEN valuenum / 2.20462 ELSE valuenum END) AS m
        FROM chartevents k WHERE k.stay_id = s.stay_id
         AND CASE WHEN itemid = 226531 THEN valuenum BETWEEN 66 AND 660
                  ELSE itemid IN (224639, 226512) AND valuenum BETWEEN 30 AND 300 END
        GROUP BY itemid = 226531))) AS weight_kg
FROM icustays s""")
cte("cr", """
SELECT subject_id, hadm_id, charttime, valuenum AS creatinine_mg_dl FROM labevents
WHERE itemid = 50912 AND valuenum >= 0.1 AND valuenum <= 30""")
cte("base7", """
SELECT s.stay_id, s.subject_id, s.hadm_id, s.intime,
  (SELECT min(creatinine_mg_dl) FROM cr WHERE cr.subject_id = s.subject_id
    AND charttime >= s.intime - INTERVAL 7 DAY AND charttime <= s.intime - INTERVAL 1 MINUTE)
    AS baseline_7d,
  (SELECT min(creatinine_mg_dl) FROM cr WHERE cr.subject_id = s.subject_id
    AND charttime >= s.intime - INTERVAL 365 DAY AND charttime <= s.intime - INTERVAL 1 MINUTE)
    AS baseline_365d
FROM icustays s""")
cte("baselines", "SELECT *, coalesce(baseline_7d, baseline_365d) AS baseline_mg_dl FROM base7")
cte("uo_hourly", """
SELECT stay_id, date_trunc('hour', charttime) AS uo_hour,
  greatest(sum(value * CASE WHEN itemid = 227488 THEN -1 ELSE 1 END), 0) AS uo_ml
FROM outputevents WHERE value >= 0 GROUP BY ALL""")
cte("in_stay", """
SELECT s.stay_id, s.subject_id, s.hadm_id, c.charttime, c.creatinine_mg_dl
FROM cr c JOIN icustays s ON s.subject_id = c.subject_id
 AND c.charttime >= s.intime AND c.charttime <= s.intime + INTERVAL 30 DAY""")
cte("in_stay_min", """
SELECT a.*, b.baseline_mg_dl AS baseline,
  (SELECT min(x.creatinine_mg_dl) FROM in_stay x WHERE x.stay_id = a.stay_id
    AND x.charttime BETWEEN a.charttime - INTERVAL 48 HOUR AND a.charttime) AS cr_min_48h,
  (SELECT min(x.creatinine_mg_dl) FROM in_stay x WHERE x.stay_id = a.stay_id
    AND x.charttime BETWEEN a.charttime - INTERVAL 168 HOUR AND a.charttime) AS cr_min_7d
FROM in_stay a JOIN baselines b ON b.stay_id = a.stay_id""")
cte("cr_stages", """
SELECT stay_id, subject_id, hadm_id, charttime, creatinine_mg_dl, baseline, cr_min_48h, cr_min_7d,
  ref_baseline, CASE WHEN creatinine_mg_dl >= 4 AND rise >= 0.3 THEN 3
    ELSE greatest(CASE WHEN ratio >= 3 THEN 3 WHEN ratio >= 2 THEN 2 WHEN ratio >= 1.5 THEN 1
                  ELSE 0 END, CASE WHEN rise >= 0.3 THEN 1 ELSE 0 END) END AS kdigo_cr_stage
FROM (SELECT *, coalesce(baseline, cr_min_7d) AS ref_baseline,
        creatinine_mg_dl - cr_min_48h AS rise,
        creatinine_mg_dl / nullif(coalesce(baseline, cr_min_7d), 0) AS ratio FROM in_stay_min)""")
cte("hours_", """
SELECT stay_id, subject_id, unnest(generate_series(date_trunc('hour', intime),
  least(date_trunc('hour', outtime), date_trunc('hour', intime + INTERVAL 720 HOUR)),
  INTERVAL 1 HOUR)) AS t_hour FROM icustays""")
cte("dense", """
SELECT h.stay_id, h.t_hour AS uo_hour, h.subject_id, coalesce(u.uo_ml, 0) AS uo_ml,
  CAST(u.uo_ml IS NOT NULL AS INTEGER) AS has_uo
FROM hours_ h LEFT JOIN uo_hourly u ON u.stay_id = h.stay_id AND u.uo_hour = h.t_hour""")
_frames = ",\n  ".join(
    f"sum(uo_ml) OVER (PARTITION BY stay_id ORDER BY uo_hour RANGE BETWEEN INTERVAL {w-1} HOUR "
    f"PRECEDING AND CURRENT ROW) AS uo_{w}h_ml, CAST(sum(has_uo) OVER (PARTITION BY stay_id "
    f"ORDER BY uo_hour RANGE BETWEEN INTERVAL {w-1} HOUR PRECEDING AND CURRENT ROW) AS BIGINT) "
    f"AS n_obs_{w}h" for w in (6, 12, 24))
cte("trail", f"SELECT stay_id, uo_hour, {_frames}\nFROM dense")
cte("uo_stages", """
SELECT t.stay_id, uo_hour, weight_kg, uo_6h_ml, uo_12h_ml, uo_24h_ml, n_obs_6h, n_obs_12h,
  n_obs_24h,
  CASE WHEN n_obs_6h >= 2 THEN uo_6h_ml / (weight_kg * 6) END AS uo_rate_6h,
  CASE WHEN n_obs_12h >= 2 THEN uo_12h_ml / (weight_kg * 12) END AS uo_rate_12h,
  CASE WHEN n_obs_24h >= 3 THEN uo_24h_ml / (weight_kg * 24) END AS uo_rate_24h,
  CASE WHEN weight_kg IS NULL THEN NULL
       WHEN n_obs_12h >= 3 AND uo_12h_ml = 0 THEN 3
       WHEN n_obs_24h >= 3 AND uo_24h_ml / (weight_kg * 24) < 0.3 THEN 3
       WHEN n_obs_12h >= 2 AND uo_12h_ml / (weight_kg * 12) < 0.5 THEN 2
       WHEN n_obs_6h >= 2 AND uo_6h_ml / (weight_kg * 6) < 0.5 THEN 1 ELSE 0 END
    AS kdigo_uo_stage
FROM trail t JOIN weight w ON w.stay_id = t.stay_id""")
cte("carried", """
SELECT h.stay_id, h.t_hour, (SELECT k.kdigo_cr_stage FROM cr_stages k WHERE k.stay_id = h.stay_id
   AND k.charttime <= h.t_hour AND k.charttime >= h.t_hour - INTERVAL 168 HOUR
   ORDER BY k.charttime DESC, k.kdigo_cr_stage DESC LIMIT 1) AS kdigo_cr_stage
FROM hours_ h""")
cte("stages", """
SELECT c.stay_id, c.t_hour, c.kdigo_cr_stage, u.kdigo_uo_stage,
  greatest(coalesce(c.kdigo_cr_stage, 0), coalesce(u.kdigo_uo_stage, 0)) AS kdigo_stage
FROM carried c JOIN uo_stages u ON u.stay_id = c.stay_id AND u.uo_hour = c.t_hour""")
cte("onset", """
SELECT stay_id, min(t_hour) FILTER (kdigo_stage >= 1) AS onset_stage1_time,
  min(t_hour) FILTER (kdigo_stage >= 2) AS onset_stage2_time,
  min(t_hour) FILTER (kdigo_stage >= 3) AS onset_stage3_time,
  arg_min(CASE WHEN coalesce(kdigo_cr_stage, 0) < 1 THEN 'urine_output'
               WHEN coalesce(kdigo_uo_stage, 0) < 1 THEN 'creatinine' ELSE 'both' END, t_hour)
    FILTER (kdigo_stage >= 1) AS stage1_source
FROM stages GROUP BY stay_id""")
cte("stay_lm", """
SELECT stay_id, subject_id, hadm_id, intime, outtime,
  unnest(generate_series(intime + INTERVAL 24 HOUR, outtime - INTERVAL 48 HOUR,
                         INTERVAL 6 HOUR)) AS landmark_time
FROM icustays WHERE outtime - intime >= INTERVAL 30 HOUR""")
# --- sources -------------------------------------------------------------------------
oracle("s1_staged_csv", """
SELECT subject_id, hadm_id, stay_id, first_careunit, NULL::VARCHAR AS last_careunit, intime,
  outtime, los FROM icustays""", 6, "los")
oracle("s9_incremental_stage", """
SELECT subject_id, stay_id, count(*) AS n, sum(value) AS total_ml, max(charttime) AS last_time
FROM outputevents GROUP BY 1, 2""", 6, "total_ml")
oracle("s3_parquet_sink", "SELECT * FROM cr", 9, "creatinine_mg_dl")
oracle("s5_report_sink", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""", 6,
       "total")
oracle("s8_materialised_table", "SELECT stay_id, landmark_time FROM stay_lm")
oracle("s2_cast_on_stage", """
SELECT o_orderkey, o_orderdate AS placed_at,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS custkey,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders""")
oracle("s4_parquet_scan", "SELECT event_id, user_id, ts, value FROM events")
oracle("s6_signal_lookup", """
SELECT s.*, (SELECT count(*) FROM chartevents e WHERE e.itemid = s.itemid
             AND s.source = 'chartevents')
          + (SELECT count(*) FROM labevents e WHERE e.itemid = s.itemid
             AND s.source = 'labevents') AS n_rows
FROM signals s""", 9, "unit_multiplier valid_low valid_high unit_offset")
oracle("s7_window_list", """
SELECT stay_id, landmark_time, w AS window_h FROM stay_lm, (VALUES (6), (12), (24)) AS v(w)""")
oracle("s10_table_counts", """
SELECT * FROM (VALUES (0, 'icustays', (SELECT count(*) FROM icustays)),
  (1, 'labevents', (SELECT count(*) FROM labevents)),
  (2, 'chartevents', (SELECT count(*) FROM chartevents)), (3, 'omr', NULL),
  (4, 'diagnoses_icd', (SELECT count(*) FROM diagnoses_icd))) AS t(position, table_name, n_rows)""")
oracle("s11_run_columns", f"""
SELECT count(*) AS n_stays, '{CONFIG_HASH}' AS config_hash FROM icustays""")
# --- projection, filter, predicate ------------------------------------------------------
cte("first_stay", """
SELECT * FROM icustays
QUALIFY row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY intime, stay_id) = 1""")
cte("base_cohort", """
SELECT f.subject_id, f.hadm_id, f.stay_id, f.first_careunit, f.intime, f.outtime, f.los,
  p.gender AS sex, p.anchor_age AS age, p.anchor_year, p.anchor_year_group, p.dod, a.admittime,
  a.dischtime, a.deathtime, a.race AS ethnicity
FROM first_stay f, patients p, admissions a
WHERE p.subject_id = f.subject_id AND a.hadm_id = f.hadm_id AND p.anchor_age >= 18
  AND f.los >= 1.25 AND f.los <= 30""")
oracle("p1_static_columns", """
SELECT stay_id, subject_id, hadm_id, sex, age, anchor_year_group, ethnicity, intime, outtime,
  admittime, dischtime FROM base_cohort""")
oracle("p2_valid_range", "SELECT * FROM cr", 9, "creatinine_mg_dl")
oracle("p3_item_filter", """
SELECT stay_id, starttime, endtime, itemid FROM inputevents
WHERE itemid IN (221906, 222315, 221289, 221662, 221749, 221653)""")
oracle("p4_unit_conversion", """
SELECT stay_id, charttime, itemid, feature_name, v AS value FROM (
  SELECT c.*, s.*, (valuenum + unit_offset) * unit_multiplier AS v
  FROM chartevents c JOIN signals s ON s.itemid = c.itemid AND source = 'chartevents')
WHERE v >= valid_low AND v <= valid_high""", 9, "value")
oracle("p5_stage_by_ratio", """
SELECT stay_id, charttime, creatinine_mg_dl, ref_baseline, kdigo_cr_stage FROM cr_stages""",
       9, "creatinine_mg_dl ref_baseline")
oracle("p6_stage_by_rate", "SELECT stay_id, uo_hour, kdigo_uo_stage FROM uo_stages")
oracle("p7_gated_rate", "SELECT stay_id, uo_hour, uo_rate_6h, uo_rate_12h, uo_rate_24h "
       "FROM uo_stages", 9, "uo_rate_6h uo_rate_12h uo_rate_24h")
oracle("p8_combined_stage", "SELECT * FROM stages")
oracle("p9_first_available", "SELECT stay_id, baseline_mg_dl FROM baselines", 9,
       "baseline_mg_dl")
oracle("p10_eligible", """
SELECT stay_id, s.subject_id, anchor_age, los FROM icustays s
JOIN patients p ON p.subject_id = s.subject_id
WHERE anchor_age >= 18 AND los BETWEEN 30 / 24.0 AND 30""", 9, "los")
oracle("p11_diagnosis_match", """
SELECT * FROM diagnoses_icd WHERE (icd_version, icd_code) IN ((10, 'N186'), (9, '5856'))""")
oracle("p12_age_group", """
SELECT subject_id, anchor_age AS age, CASE WHEN anchor_age >= 85 THEN '85+'
  WHEN anchor_age >= 65 THEN '65-84' WHEN anchor_age >= 45 THEN '45-64' ELSE '18-44' END
  AS age_group FROM patients""")
# --- joins -------------------------------------------------------------------------------
oracle("j1_attach_static", """
SELECT stay_id, s.subject_id, s.hadm_id, gender, anchor_age, race, admittime
FROM icustays s JOIN patients p ON p.subject_id = s.subject_id
JOIN admissions a ON a.hadm_id = s.hadm_id""")
oracle("j2_attach_optional", """
SELECT s.stay_id, s.subject_id, weight_kg FROM icustays s
LEFT JOIN weight w ON w.stay_id = s.stay_id""", 9, "weight_kg")
oracle("j3_densify", "SELECT stay_id, subject_id, uo_hour, uo_ml, has_uo FROM dense", 9, "uo_ml")
oracle("j4_lookback_join", """
SELECT s.stay_id, s.subject_id, s.intime, c.charttime, c.creatinine_mg_dl FROM icustays s
LEFT JOIN cr c ON c.subject_id = s.subject_id AND c.charttime < s.intime
 AND c.charttime >= s.intime - INTERVAL 365 DAY""", 9, "creatinine_mg_dl")
oracle("j5_events_in_episode", """
SELECT s.stay_id, s.subject_id, s.intime, c.charttime, c.creatinine_mg_dl FROM icustays s
JOIN cr c ON c.subject_id = s.subject_id
 AND c.charttime BETWEEN s.intime AND s.intime + INTERVAL 30 DAY""", 9, "creatinine_mg_dl")
oracle("j6_asof_join", "SELECT * FROM carried")
oracle("j7_window_join", """
SELECT l.stay_id, l.landmark_time, w AS window_h, e.event_id
FROM stay_lm l, (VALUES (6), (12), (24)) AS v(w), ev e
WHERE e.stay_id = l.stay_id AND e.ts <= l.landmark_time
  AND e.ts > l.landmark_time - to_hours(w)""")
oracle("j8_landmark_windows", """
SELECT stay_id, landmark_time, w AS window_h, landmark_time - to_hours(w) AS window_start
FROM stay_lm, (VALUES (6), (12), (24)) AS v(w)""")
oracle("j9_overlap_flag", """
SELECT stay_id, landmark_time, CAST(EXISTS (SELECT 1 FROM inputevents i
  WHERE i.stay_id = l.stay_id AND i.starttime <= l.landmark_time
    AND i.endtime > l.landmark_time - INTERVAL 24 HOUR) AS INTEGER) AS overlap FROM stay_lm l""")
oracle("j10_lookback_closed", """
SELECT l.stay_id, l.landmark_time,
  CAST(count(*) FILTER (i.starttime BETWEEN l.landmark_time - INTERVAL 24 HOUR
                        AND l.landmark_time) > 0 AS INTEGER) AS given_24h, """ + ", ".join(
    f"sum(amount) FILTER (i.starttime BETWEEN l.landmark_time - INTERVAL {w} HOUR "
    f"AND l.landmark_time) AS amount_{w}h" for w in (6, 12, 24)) + """
FROM stay_lm l LEFT JOIN inputevents i ON i.stay_id = l.stay_id GROUP BY 1, 2""",
       9, "amount_6h amount_12h amount_24h")
oracle("j11_map_signals", """
SELECT labevent_id, l.itemid, feature_name, valid_low, valid_high FROM labevents l
JOIN signals s ON s.itemid = l.itemid AND source = 'labevents'""")
cte("excluded", """
SELECT subject_id FROM diagnoses_icd
WHERE (icd_version = 10 AND icd_code = 'N186') OR (icd_version = 9 AND icd_code = '5856')""")
oracle("j12_exclude", """
SELECT stay_id, subject_id FROM icustays
WHERE subject_id NOT IN (SELECT subject_id FROM excluded)""")
oracle("j13_exists_in_horizon", "SELECT stay_id, landmark_time, " + ", ".join(
    f"CAST(EXISTS (SELECT 1 FROM ev e WHERE e.stay_id = l.stay_id AND e.event_type = 'error' "
    f"AND e.ts > l.landmark_time AND e.ts <= l.landmark_time + INTERVAL {h} HOUR) AS INTEGER) "
    f"AS seen_{h}h" for h in (24, 48)) + " FROM stay_lm l")
oracle("j14_first_match", """
SELECT s.stay_id, (SELECT event_type FROM ev e WHERE e.stay_id = s.stay_id AND value >= 60
                   ORDER BY ts LIMIT 1) AS first_kind FROM icustays s""")
oracle("j15_join_blocks", """
SELECT l.stay_id, l.landmark_time,
  coalesce(max(CASE WHEN starttime >= landmark_time - INTERVAL 6 HOUR
                     AND starttime <= landmark_time THEN 1 END), 0) AS flag,
  sum(amount) FILTER (starttime >= landmark_time - INTERVAL 24 HOUR
                      AND starttime <= landmark_time) AS sum_24h
FROM stay_lm l LEFT JOIN inputevents i ON i.stay_id = l.stay_id GROUP BY 1, 2""", 9, "sum_24h")
# --- grids ---------------------------------------------------------------------------------
oracle("g1_hourly_grid", "SELECT * FROM hours_")
oracle("g2_landmarks", "SELECT stay_id, subject_id, intime, landmark_time FROM stay_lm")
oracle("g3_incident_landmarks", """
SELECT l.stay_id, landmark_time, onset_stage1_time FROM stay_lm l
JOIN onset o ON o.stay_id = l.stay_id
WHERE NOT coalesce(landmark_time >= onset_stage1_time, FALSE)""")
oracle("g4_hours_since", """
SELECT stay_id, landmark_time, date_diff('hour', intime, landmark_time) AS hours FROM stay_lm""")
oracle("g5_unnest", """
SELECT event_id, unnest(range(0, event_id % 4 + 1)) AS step FROM events""")
# --- concepts --------------------------------------------------------------------------------
oracle("a1_episode_weight", "SELECT * FROM weight", 9, "weight_kg")
oracle("a2_baseline", "SELECT * FROM baselines", 9, "baseline_7d baseline_365d baseline_mg_dl")
oracle("a3_signed_hourly_sum", "SELECT * FROM uo_hourly", 6, "uo_ml")
oracle("a4_onset", "SELECT * FROM onset")
oracle("c1_rate_stages", "SELECT * FROM uo_stages", 6,
       "weight_kg uo_6h_ml uo_12h_ml uo_24h_ml uo_rate_6h uo_rate_12h uo_rate_24h")
oracle("c1_ratio_stages", "SELECT * FROM cr_stages", 9,
       "creatinine_mg_dl baseline cr_min_48h cr_min_7d ref_baseline")
oracle("w1_first_episode", "SELECT subject_id, hadm_id, stay_id, intime FROM first_stay")
oracle("w2_trailing_min", """
SELECT stay_id, ts,
  min(value) OVER (PARTITION BY stay_id ORDER BY ts
    RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS min_48h,
  min(value) OVER (PARTITION BY stay_id ORDER BY ts
    RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW) AS min_7d
FROM ev WHERE event_type = 'purchase'""", 9, "min_48h min_7d")
oracle("w3_trailing_sums", """
SELECT stay_id, uo_hour, uo_6h_ml AS ml_6h, n_obs_6h AS n_6h, uo_12h_ml AS ml_12h,
  n_obs_12h AS n_12h, uo_24h_ml AS ml_24h, n_obs_24h AS n_24h FROM trail""",
       6, "ml_6h ml_12h ml_24h")
oracle("w5_carry_forward", """
SELECT h.stay_id, h.t_hour, (SELECT event_id FROM ev e WHERE e.stay_id = h.stay_id
   AND e.event_type = 'view' AND e.ts <= h.t_hour ORDER BY ts DESC, event_id DESC LIMIT 1)
  AS event_id FROM hours_ h""")
oracle("u1_union_events", """
SELECT subject_id, 'lab' AS source, charttime, valuenum FROM labevents UNION ALL
SELECT subject_id, 'chart', charttime, valuenum FROM chartevents""", 9, "valuenum")
oracle("u2_distinct_keys", "SELECT DISTINCT subject_id, hadm_id, itemid FROM chartevents")
# --- scalar functions -------------------------------------------------------------------------
oracle("f1_hour_floor", "SELECT event_id, date_trunc('hour', ts) AS t_hour FROM events")
oracle("f2_time_arithmetic", """
SELECT stay_id, intime + INTERVAL 24 HOUR AS first_landmark,
  outtime - INTERVAL 48 HOUR AS last_landmark, epoch_us(outtime) - epoch_us(intime) AS length_us
FROM icustays""")
oracle("f3_hour_boundaries", """
SELECT stay_id, date_diff('hour', intime, outtime) AS ahead,
  date_diff('hour', outtime, intime) AS back FROM icustays""")
oracle("f4_series", """
SELECT stay_id, unnest(generate_series(hour(intime), hour(outtime))) AS h FROM icustays""")
oracle("f5_greatest_least", """
SELECT stay_id, greatest(baseline_7d, baseline_365d, 0.5) AS hi,
  least(baseline_7d, baseline_365d, 0.5) AS lo FROM baselines""", 9, "hi lo")
oracle("f6_null_handling", """
SELECT event_id, coalesce(CASE WHEN value > 50 THEN value - 50 END, -1) AS above,
  nullif(event_type, 'view') AS kind, value / nullif(event_id % 3, 0) AS ratio,
  CASE WHEN value - 50 > 50 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS level
FROM events""", 9, "above ratio")
oracle("f7_casts", """
SELECT event_id, event_id::VARCHAR AS id_text, event_type || '_' || hour(ts) || 'h' AS tag,
  TRY_CAST(event_type AS DOUBLE) AS not_a_number, ts::DATE AS day FROM events""")
oracle("f8_aggregates", """
SELECT user_id AS subject_id, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean,
  stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, median(value) AS mid,
  round(avg(value), 1) AS mean_1 FROM events GROUP BY ALL""", 6, "total mean std mid")
oracle("f9_logit", """
SELECT event_id, ln(p / (1 - p)) AS logit_p, abs(p - 0.5) AS gap, sqrt(p) AS root,
  exp(p) AS growth FROM (SELECT event_id, value / 500.0 AS p FROM events)""",
       9, "logit_p gap root growth")
oracle("f10_bin_index", """
SELECT event_id, CASE WHEN value < 10 THEN 0 WHEN value < 25 THEN 1 WHEN value < 50 THEN 2
  ELSE 3 END AS bin FROM events""")
oracle("f11_round_half_even", """
SELECT event_id, CAST(round_even(floor(value) / 2.0, 0) AS INTEGER) AS points FROM events""")
oracle("f12_range_label", """
SELECT event_id, CASE WHEN value < 20 THEN '< ' || h WHEN value >= 90 THEN '>= ' || l
  ELSE l || ' to < ' || h END AS label
FROM (SELECT event_id, value,
   regexp_replace(printf('%.2f', floor(value / 10) * 10 / 4.0), '\\.?0+$', '') AS l,
   regexp_replace(printf('%.2f', (floor(value / 10) * 10 + 10) / 4.0), '\\.?0+$', '') AS h
 FROM events)""")
