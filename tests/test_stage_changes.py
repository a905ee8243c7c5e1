"""Onset from the hours where a stage can change, against every hour; pruned pivots."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from landmarkflow.config import StagingConfig
from landmarkflow.functions.timefns import DAY_US, HOUR_US
from landmarkflow.operators import concepts as cc
from landmarkflow.operators.features import pivot_features
from landmarkflow.operators.rolling import fold_signals
from landmarkflow.operators.windows import trailing_min

T0 = datetime(2024, 1, 1, 0, 30)
H = timedelta(hours=1)
CFG = StagingConfig(rate_min_observed=(1, 2, 2), anuria_min_observed=2, carry_hours=30)


def clinical(spark, seed=3):
    """Stays of many lengths; stay 1 has most rows; some events lie outside their stay."""
    rng = np.random.default_rng(seed)
    length = {i: int(rng.integers(0, 200)) for i in range(2, 40)} | {1: 800, 40: None}
    episodes = spark.createDataFrame(
        [(i, i, i, T0, None if n is None else T0 + n * H) for i, n in length.items()],
        "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, "
        "outtime timestamp_ntz")
    output, staged = [], []
    for i in length:
        for h in np.unique(rng.integers(-30, 250, 300 if i == 1 else int(rng.integers(0, 12)))):
            output.append((i, T0.replace(minute=0) + int(h) * H,
                           float(rng.choice([0.0, 5.0, 400.0]))))
        for m in rng.integers(-3000, 12000, 200 if i == 1 else int(rng.integers(0, 6))):
            m = int(m) // 60 * 60 + 30 if m % 2 else int(m)  # half of them on the hour
            staged.append((i, T0 + timedelta(minutes=m), int(rng.integers(0, 4))))
    hourly = spark.createDataFrame(output, "stay_id long, uo_hour timestamp_ntz, uo_ml double")
    by_ratio = spark.createDataFrame(staged, "stay_id long, charttime timestamp_ntz, "
                                             "kdigo_cr_stage int")
    weight = spark.createDataFrame([(i, None if i % 7 == 0 else 70.0) for i in length],
                                   "stay_id long, weight_kg double")
    return episodes, hourly, weight, by_ratio


def test_onset_from_changes_equals_every_hour(spark):
    episodes, hourly, weight, by_ratio = clinical(spark)
    dense = cc.combined_stages(cc.rate_stages(episodes, hourly, weight, CFG), by_ratio, CFG)
    sparse = cc.stage_changes(episodes, hourly, weight, by_ratio, CFG)
    want = sorted(map(str, cc.onset(dense).collect()))
    assert sorted(map(str, cc.onset(sparse).collect())) == want and len(want) == 40
    keys = ["stay_id", "t_hour"]
    assert sparse.count() == sparse.select(*keys).distinct().count()
    assert sparse.exceptAll(dense.select(sparse.columns)).count() == 0


def test_changes_grow_with_events_not_with_hours(spark):
    episodes, hourly, weight, by_ratio = clinical(spark)
    n = cc.stage_changes(episodes.filter("stay_id = 40"), hourly.limit(0), weight,
                         by_ratio.limit(0), CFG).count()
    assert n == 1  # an open stay of 721 hours without events


def test_trailing_min_of_falling_values_is_the_own_value(spark):
    rows = [(k, T0 + i * H, float(1000 - i)) for k in range(5) for i in range(200)]
    ev = spark.createDataFrame(rows, "key long, t timestamp_ntz, value double")
    spans = {"a": 48 * HOUR_US, "b": 3 * DAY_US + 17}
    got = trailing_min(ev, ev, "key", "t", "t", "value", spans)
    assert got.join(ev, ["key", "t"]).filter("a = value and b = value").count() == len(rows)


def test_trailing_min_of_queries_without_events(spark):
    ev = spark.createDataFrame([(1, T0, 5.0), (1, T0 - 50 * H, float("nan"))],
                               "key long, t timestamp_ntz, value double")
    ask = spark.createDataFrame([(1, T0 + 10 * H), (1, T0 - H), (2, T0), (1, None)],
                                "key long, q timestamp_ntz")
    got = {(r["key"], r["q"]): r["a"] for r in
           trailing_min(ask, ev, "key", "q", "t", "value", {"a": 60 * HOUR_US}).collect()}
    assert got[(1, T0 + 10 * H)] == 5.0 and np.isnan(got[(1, T0 - H)])
    assert got[(2, T0)] is None and len(got) == 3


def test_pivot_computes_only_columns_asked_for(spark):
    rows = [(1, 0, "x", 1.0, 2), (1, 0, "y", 3.0, 0)]
    wide = spark.createDataFrame(rows, "stay_id long, landmark_idx int, feature_name string, "
                                       "mean_6h double, count_6h long")
    out = pivot_features(wide, ["x", "y", "z"], (6,), ("mean", "count"))
    assert out.select("x_mean_6h", "y_mean_6h", "z_mean_6h", "x_count_6h", "y_count_6h"
                      ).first()[:] == (1.0, 3.0, None, 2, None)
    plan = out.select("x_mean_6h")._jdf.queryExecution().optimizedPlan().toString()
    assert "count_6h" not in plan.split("LogicalRDD")[0]
    assert out.agg(F.count("*")).first()[0] == 1


def test_folded_signals_keep_landmarks_and_listed_values(spark):
    rows = [(1, "x", T0, 1.0), (1, "u", T0, 2.0), (2, "u", T0, 3.0), (2, "v", T0, 4.0)]
    ev = spark.createDataFrame(rows, "stay_id long, feature_name string, t timestamp_ntz, "
                                     "value double")
    got = fold_signals(ev, ["x", "z"]).groupBy("stay_id", "feature_name").count().collect()
    assert sorted(map(tuple, got)) == [(1, "other", 1), (1, "x", 1), (2, "other", 2)]
