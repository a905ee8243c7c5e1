"""One key holding most of the rows: results stay whole and plans stay spread."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landmarkflow.functions.quantiles import exact_quantiles
from landmarkflow.functions.timefns import DAY_US, HOUR_US
from landmarkflow.operators.grid import landmarks
from landmarkflow.operators.joins import asof_join, events_in_episode, salted_join
from landmarkflow.operators.rolling import rolling_features
from landmarkflow.operators.splits import group_kfold, packing_runs
from landmarkflow.operators.windows import trailing_min

T0 = datetime(2024, 1, 1, 3, 17, 5, 123456)


def hot_events(n=3000, seed=1):
    """A third of all rows under key 1, the rest over 200 keys; ties included."""
    rng = np.random.default_rng(seed)
    key = np.where(np.arange(n) % 3 == 0, 1, rng.integers(2, 200, n))
    minutes = rng.integers(0, 20 * 24 * 60, n)
    return pd.DataFrame({"key": key.astype("int64"),
                         "t": [T0 + timedelta(minutes=int(m)) for m in minutes],
                         "value": np.round(rng.gamma(2.0, 10.0, n), 2)})


@pytest.fixture(scope="module")
def ev(spark):
    pdf = hot_events()
    rows = [(int(k), t.to_pydatetime(), float(v)) for k, t, v in pdf.itertuples(index=False)]
    sdf = spark.createDataFrame(rows, "key long, t timestamp_ntz, value double")
    return pdf, sdf


def test_trailing_min_equals_brute_force(ev):
    pdf, sdf = ev
    spans = {"a": 48 * HOUR_US, "b": 7 * DAY_US, "c": DAY_US + 12345}
    got = trailing_min(sdf, sdf, "key", "t", "t", "value", spans).toPandas()
    want = {}
    for k, g in pdf.groupby("key"):
        t, v = g["t"].to_numpy("datetime64[us]").astype("int64"), g["value"].to_numpy()
        for q in np.unique(t):
            want[(k, q)] = [v[(t <= q) & (t >= q - us)].min() for us in spans.values()]
    assert len(got) == len(want)
    us = got["t"].to_numpy("datetime64[us]").astype("int64")
    for k, q, *vals in zip(got["key"], us, got["a"], got["b"], got["c"], strict=True):
        assert vals == want[(k, q)]


def test_asof_join_equals_brute_force(spark, ev):
    pdf, sdf = ev
    grid = [(k, T0 + timedelta(hours=h)) for k in (1, 2, 3, 250) for h in range(-5, 500, 7)]
    left = spark.createDataFrame(grid, "key long, at timestamp_ntz")
    for tol in (None, 30):
        got = asof_join(left, sdf, "key", "at", "t", "value", tol).toPandas()
        assert len(got) == len(grid)
        for k, at, v in got.itertuples(index=False):
            g = pdf[(pdf["key"] == k) & (pdf["t"] <= at)]
            if tol is not None and len(g):
                g = g if g["t"].max() >= at - timedelta(hours=tol) else g.iloc[:0]
            if not len(g):
                assert np.isnan(v)
            else:
                assert v == g[g["t"] == g["t"].max()]["value"].max()


def test_windows_are_keyed_by_time_bucket(ev):
    """No window partition of the row data is a whole key."""
    _, sdf = ev
    plan = trailing_min(sdf, sdf, "key", "t", "t", "value", {"a": DAY_US}
                        )._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rolling_equals_brute_force(spark, ev):
    pdf, sdf = ev
    stays = spark.createDataFrame(
        [(k, k, k, T0 - timedelta(hours=2), T0 + timedelta(days=20)) for k in range(1, 30)],
        "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
    events = sdf.select(F.col("key").alias("stay_id"), F.lit("f").alias("feature_name"), "t",
                        "value")
    got = rolling_features(landmarks(stays), events).toPandas()
    checked = 0
    for k, g in got.groupby("stay_id"):
        e = pdf[pdf["key"] == k]
        for r in g.sample(min(len(g), 12), random_state=0).itertuples():
            inside = e[(e["t"] <= r.landmark_time)
                       & (e["t"] > r.landmark_time - timedelta(hours=r.window_h))]
            assert r.n_count == len(inside)
            assert r.mean_val == pytest.approx(inside["value"].mean())
            if len(inside) > 1:
                assert r.std_val == pytest.approx(inside["value"].std())
            assert r.latest_val == inside[inside["t"] == inside["t"].max()]["value"].max()
            assert r.earliest_val == inside[inside["t"] == inside["t"].min()]["value"].min()
            checked += 1
    assert checked > 100


def test_events_in_episode_equals_brute_force(spark, ev):
    pdf, sdf = ev
    eps = [(i, k, T0 + timedelta(days=d)) for i, (k, d) in enumerate(
        (k, d) for k in (1, 2, 5) for d in (-40, -3, 0, 9))]
    ep = spark.createDataFrame(eps, "stay_id long, key long, intime timestamp_ntz")
    got = events_in_episode(ep, sdf, 5, "key", "t").count()
    want = sum(((pdf["key"] == k) & (pdf["t"] >= a) & (pdf["t"] <= a + timedelta(days=5))).sum()
               for _, k, a in eps)
    assert got == want > 0


def test_salted_join_keeps_all_rows_and_a_second_exchange(spark, ev):
    pdf, sdf = ev
    dim = sdf.select("key").distinct().withColumn("w", F.col("key") * 2)
    out = salted_join(sdf, dim.filter("key <> 7"), "key", "left")
    assert out.count() == len(pdf)
    assert out.filter("key <> 7 and w is null").count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = (salted_join(sdf, dim, "key").groupBy("key").agg(F.sum("value"))
                ._jdf.queryExecution().sparkPlan().toString())
        full = (salted_join(sdf, dim, "key").groupBy("key").agg(F.sum("value"))
                ._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "partial_sum" in plan or "partial_sum" in full
    assert "_part" in full


def test_runs_equal_greedy_packing():
    """Whole rounds at once give what one group after the other to the lightest fold gives."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        k = int(rng.integers(1, 7))
        top = int(rng.choice([3, 40, 1000]))
        sizes = sorted({int(x) for x in rng.integers(1, top, rng.integers(1, 9))}, reverse=True)
        table = [(s, int(rng.integers(1, 60))) for s in sizes]
        loads, want = [0] * k, []
        for size, n in table:
            for _ in range(n):
                at = loads.index(min(loads))
                loads[at] += size
                want.append((size, at))
        got = []
        for size, a, b, folds in packing_runs(table, k):
            assert a == len(got)
            got += [(size, folds[i % len(folds)]) for i in range(b - a)]
        assert got == want
    assert len(packing_runs([(1000, 3), (1, 10**9)], 5)) < 40


def test_group_kfold_is_disjoint_and_balanced(spark, ev):
    pdf, sdf = ev
    got = group_kfold(sdf, "key", 5).toPandas()
    assert len(got) == len(pdf)
    assert got.groupby("key")["fold"].nunique().max() == 1
    rest = got[got["key"] != 1]["fold"].value_counts()
    assert set(got["fold"]) == set(range(5)) and rest.max() < 2 * rest.min()


def test_exact_quantiles_equal_numpy(spark, ev):
    pdf, sdf = ev
    probs = [0.0, 0.1, 0.25, 0.5, 0.85, 1.0]
    got = exact_quantiles(sdf, ["key"], "value", probs).toPandas()
    for k in (1, 2, 3, 77):
        vals = pdf[pdf["key"] == k]["value"].to_numpy()
        mine = got[got["key"] == k].sort_values("prob")["quantile"].to_numpy()
        assert mine == pytest.approx(np.quantile(vals, probs))
    whole = exact_quantiles(sdf, [], "value", [0.5]).first()["quantile"]
    assert whole == pytest.approx(np.quantile(pdf["value"], 0.5))
    same = exact_quantiles(sdf.withColumn("value", F.lit(3.5)), [], "value", [0.3]).first()
    assert same["quantile"] == 3.5
