"""Cells of equal relative width, columns handed on, filters that reach the scan."""

import random

from pyspark.sql import functions as F

from landmarkflow.functions.quantiles import exact_quantiles
from landmarkflow.functions.scalars import order_cell, share_cell
from landmarkflow.operators.exposure import exposure_events


def test_cells_follow_the_order_and_do_not_crowd(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 1e-5) for _ in range(4000)] + [rng.random() for _ in range(4000)]
    values += [0.0, 1.0, 0.5, 1e-300, 1 - 1e-16, 2.0, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    rows = sorted(tuple(r) for r in df.select("p", share_cell("p")).collect())
    assert [c for _, c in rows] == sorted(c for _, c in rows)
    counts = df.groupBy(share_cell("p").alias("c")).count().agg(F.max("count")).first()[0]
    assert counts < 80
    wide = [rng.gauss(37, 5) for _ in range(4000)] + [1e9, -3.0, 0.0, -1e-9, float("inf")]
    df = spark.createDataFrame([(v,) for v in wide], "v double")
    rows = sorted(tuple(r) for r in df.select("v", order_cell("v")).collect())
    assert [c for _, c in rows] == sorted(c for _, c in rows)
    assert df.groupBy(order_cell("v").alias("c")).count().agg(F.max("count")).first()[0] < 80


def test_quantiles_with_an_outlier(spark):
    values = [float(k) for k in range(-50, 951)] + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.prob: r.quantile for r in exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {0.0: -50.0, 0.25: 200.25, 0.5: 450.5, 1.0: 1e9}


def test_exposure_filters_reach_the_scan(spark, tmp_path):
    given = spark.createDataFrame(
        [(1, 221906, None, 1.0)], "stay_id bigint, itemid bigint, amountuom string, amount double")
    given = given.withColumns({"starttime": F.lit("2150-01-01").cast("timestamp_ntz"),
                               "endtime": F.lit("2150-01-02").cast("timestamp_ntz")})
    given.write.parquet(str(tmp_path / "i"))
    charts = given.select("stay_id", "itemid", F.col("starttime").alias("charttime"),
                          F.col("amount").alias("value"))
    charts.write.parquet(str(tmp_path / "c"))
    read = spark.read.parquet
    events = exposure_events(read(str(tmp_path / "i")), read(str(tmp_path / "c")),
                             read(str(tmp_path / "c")))
    plan = events._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "PushedFilters" in x]
    assert len(scans) == 3 and all("In(itemid" in x for x in scans)
    assert [r.kind for r in events.collect()] == ["vaso"]


def test_predictions_carry_what_the_subgroup_report_reads(spark):
    from landmarkflow.evaluation.fairness import subgroup_rows
    from landmarkflow.models.train import predict_all

    class Constant:
        def score(self, df):
            return df.withColumn("p", F.lit(0.5))

    rows = [(k, k, "F" if k % 2 else "M", 30 + k, "WHITE", "test", k % 2) for k in range(6)]
    matrix = spark.createDataFrame(rows, "stay_id int, subject_id int, sex string, age int, "
                                         "ethnicity string, split string, y_stage1_24h int")
    matrix = matrix.withColumn("landmark_time", F.lit("2150-01-01").cast("timestamp_ntz"))
    out = predict_all({("aki_stage1_24h", "combined", "m"): Constant()}, {"combined": matrix})
    kinds = {r.attribute for r in subgroup_rows(out).collect()}
    assert kinds == {"sex", "age_group", "ethnicity_group"}
