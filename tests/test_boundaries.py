"""Closed and open window ends, ties, empty windows: hand-made frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from landmarkflow.config import Config, StagingConfig
from landmarkflow.operators import cohort as co
from landmarkflow.operators import concepts as cc
from landmarkflow.operators import exposure, grid
from landmarkflow.operators import labels as lb
from landmarkflow.operators.rolling import rolling_features

T0 = datetime(2024, 1, 1, 0, 30)
H = timedelta(hours=1)
US = timedelta(microseconds=1)
LM = T0 + 24 * H


def stays(spark, length=72 * H):
    return spark.createDataFrame([(1, 10, 100, T0, T0 + length)],
                                 "stay_id long, subject_id long, hadm_id long, "
                                 "intime timestamp_ntz, outtime timestamp_ntz")


def events(spark, rows):
    return spark.createDataFrame([(1, "f", t, float(v)) for t, v in rows],
                                 "stay_id long, feature_name string, t timestamp_ntz, value double")


@pytest.mark.parametrize("length,n", [(72 * H - US, 0), (72 * H, 1), (78 * H - US, 1),
                                      (78 * H, 2), (30 * H, 0)])
def test_landmark_count(spark, length, n):
    assert grid.landmarks(stays(spark, length)).count() == n


def test_open_episode_has_no_landmarks(spark):
    open_stay = stays(spark).withColumn("outtime", F.lit(None).cast("timestamp_ntz"))
    assert grid.landmarks(open_stay).count() == 0
    assert grid.hourly_grid(open_stay, 1).count() == 25  # runs to the cap


def rolled(spark, rows):
    out = rolling_features(grid.landmarks(stays(spark)), events(spark, rows)).collect()
    return {r["window_h"]: r for r in out}


def test_window_is_open_at_its_start_and_closed_at_the_landmark(spark):
    r = rolled(spark, [(LM, 1), (LM - 6 * H, 2), (LM - 12 * H + US, 3), (LM - 24 * H, 4),
                       (LM + US, 5)])
    assert {w: r[w]["n_count"] for w in r} == {6: 1, 12: 3, 24: 3}
    assert r[6]["latest_val"] == 1 and r[24]["earliest_val"] == 3


def test_ties_and_single_rows(spark):
    r = rolled(spark, [(LM - H, 7), (LM - H, 9), (LM - 20 * H, 2)])
    assert r[6]["latest_val"] == 9 and r[6]["earliest_val"] == 7 and r[6]["delta_val"] == 2
    one = rolled(spark, [(LM - H, 7)])
    assert one[6]["std_val"] is None and one[6]["delta_val"] == 0
    assert rolled(spark, [(LM - 30 * H, 7)]) == {}


def test_constant_values_have_no_spread(spark):
    r = rolled(spark, [(LM - i * H, 0.1) for i in range(1, 24)])
    assert r[24]["std_val"] == pytest.approx(0, abs=1e-12)


def test_exposure_boundaries(spark):
    lm = grid.landmarks(stays(spark))
    inputs = spark.createDataFrame(
        [(1, LM - 40 * H, LM - 24 * H, 221906, 1.0, "mg"),   # ends at the open end: not running
         (1, LM - 24 * H, LM - 24 * H, 221794, 1.0, "mg"),   # starts at the closed end
         (1, LM - 6 * H, LM, 1, 5.0, "mL")],
        "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, itemid long, "
        "amount double, amountuom string")
    none = spark.createDataFrame([], "stay_id long, charttime timestamp_ntz, itemid long, "
                                     "value double")
    row = exposure.treatment_block(lm, inputs, none, none).first()
    assert (row["vasopressor_any_24h"], row["loop_diuretic_24h"], row["mech_vent_24h"]) == (0, 1, 0)
    assert row["fluid_input_ml_6h"] == 5.0
    assert row["urine_output_ml_24h"] == 0.0
    running = inputs.withColumn("endtime", F.col("endtime") + F.expr("INTERVAL '1' SECOND"))
    assert exposure.treatment_block(lm, running, none, none).first()["vasopressor_any_24h"] == 1
    empty = exposure.treatment_block(lm, inputs.filter("itemid < 0"), none, none).first()
    assert empty["fluid_input_ml_24h"] is None and empty["urine_output_ml_6h"] == 0.0


@pytest.mark.parametrize("offset,want", [(timedelta(0), (0, 0)), (US, (1, 1)), (24 * H, (1, 1)),
                                         (24 * H + US, (0, 1)), (48 * H, (0, 1)),
                                         (48 * H + US, (0, 0))])
def test_label_horizon(spark, offset, want):
    at = LM + offset
    lm = grid.landmarks(stays(spark)).withColumn(
        "onset_stage1_time", F.lit(at).cast("timestamp_ntz")).withColumn(
        "onset_stage2_time", F.lit(None).cast("timestamp_ntz"))
    row = lb.horizon_labels(lm).first()
    assert (row["y_stage1_24h"], row["y_stage1_48h"], row["y_stage2_48h"]) == (*want, 0)
    staged = spark.createDataFrame([(1, at, 1)], "stay_id long, charttime timestamp_ntz, "
                                                 "kdigo_cr_stage int")
    seen = lb.event_labels(lm, staged).first()
    assert (seen["y_cr_only_stage1_24h"], seen["y_cr_only_stage1_48h"]) == want


def test_onset_at_landmark_drops_it(spark):
    lm = grid.landmarks(stays(spark)).withColumn("onset_stage1_time", F.col("landmark_time"))
    assert grid.drop_after_onset(lm).count() == 0
    assert grid.drop_after_onset(lm, enabled=False).count() == 1


def test_baseline_window(spark):
    minute = timedelta(minutes=1)
    rows = [(10, T0 - minute, 3.0), (10, T0 - minute / 2, 1.0), (10, T0 - 7 * 24 * H, 2.5),
            (10, T0 - 7 * 24 * H - US, 2.0), (10, T0 - 365 * 24 * H, 1.5),
            (10, T0 - 365 * 24 * H - US, 0.5)]
    cr = spark.createDataFrame(rows, "subject_id long, charttime timestamp_ntz, "
                                     "creatinine_mg_dl double")
    row = cc.baseline(stays(spark), cr).first()
    assert (row["baseline_7d"], row["baseline_365d"], row["baseline_mg_dl"]) == (2.5, 1.5, 2.5)
    none = cc.baseline(stays(spark), cr.filter("subject_id < 0")).first()
    assert none["baseline_mg_dl"] is None


def test_staging_range_and_ladder(spark):
    day = 24 * H
    rows = [(10, 100, T0 - US, 9.0), (10, 100, T0, 1.0), (10, 100, T0 + 40 * H, 1.3),
            (10, 100, T0 + 3 * day, 4.5), (10, 100, T0 + 30 * day, 4.5),
            (10, 100, T0 + 30 * day + US, 9.0)]
    cr = spark.createDataFrame(rows, "subject_id long, hadm_id long, charttime timestamp_ntz, "
                                     "creatinine_mg_dl double")
    base = spark.createDataFrame([(1, None)], "stay_id long, baseline_mg_dl double")
    got = [(r["kdigo_cr_stage"], r["cr_min_48h"]) for r in
           cc.ratio_stages(stays(spark), cr, base).orderBy("charttime").collect()]
    # 1.3 is a rise of 0.3; 4.5 against 1.0 is stage 3; a stable 4.5 later is none
    assert got == [(0, 1.0), (1, 1.0), (3, 1.3), (0, 4.5)]


def test_rate_ladder_needs_weight(spark):
    hourly = spark.createDataFrame([(1, T0.replace(minute=0), 0.0)],
                                   "stay_id long, uo_hour timestamp_ntz, uo_ml double")
    cfg = StagingConfig(rate_min_observed=(1, 1, 1), anuria_min_observed=1)
    unknown = spark.createDataFrame([(1, None)], "stay_id long, weight_kg double")
    known = spark.createDataFrame([(1, 70.0)], "stay_id long, weight_kg double")
    assert cc.rate_stages(stays(spark), hourly, unknown, cfg).filter(
        "kdigo_uo_stage is not null").count() == 0
    assert cc.rate_stages(stays(spark), hourly, known, cfg).agg(
        F.max("kdigo_uo_stage")).first()[0] == 3


def test_weight_sources(spark):
    inputs = spark.createDataFrame([(1, 20.0), (1, 400.0)], "stay_id long, patientweight double")
    chart = spark.createDataFrame([(1, 224639, 80.0), (1, 226512, 90.0), (1, 226531, 220.462),
                                   (1, 226531, 900.0)],
                                  "stay_id long, itemid long, valuenum double")
    got = cc.episode_weight(stays(spark), inputs, chart).first()["weight_kg"]
    assert got == pytest.approx((85.0 + 100.0) / 2)


def test_first_episode_and_age_groups(spark):
    two = stays(spark).unionByName(stays(spark).withColumn("stay_id", F.lit(2).cast("long")))
    assert [r["stay_id"] for r in co.first_episode(two).collect()] == [1]
    ages = spark.createDataFrame([(44,), (45,), (65,), (85,)], "age int")
    assert [r[0] for r in ages.select(co.age_group()).collect()] == ["18-44", "45-64", "65-84",
                                                                      "85+"]


def test_fingerprint_is_stable_and_sensitive():
    assert Config().fingerprint() == Config().fingerprint()
    assert Config().fingerprint() != Config(seed=1).fingerprint()
    assert len(Config().fingerprint()) == 16


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Lord_Howe"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    """Local times around a clock change stay apart and keep their distance."""
    from landmarkflow.functions.timefns import hour_boundaries, hour_floor, micros

    at = [datetime(2024, 3, 10, 1, 59, 59, 999999), datetime(2024, 3, 10, 2, 30),
          datetime(2024, 11, 3, 1, 15), datetime(1969, 12, 31, 23, 0, 0, 1)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")

    def measured():
        return df.select(micros("t").alias("us"), hour_floor("t").alias("h"), hour_boundaries(
            F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00'"), "t").alias("n")).collect()

    want = measured()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = measured()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
    epoch = datetime(1970, 1, 1)
    assert [r["us"] for r in want] == [(t - epoch) // timedelta(microseconds=1) for t in at]
