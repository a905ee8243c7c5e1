"""Splits, drift, invariants, families, sinks and helpers."""

import pytest
from pyspark.sql import functions as F

from landmarkflow import config as C
from landmarkflow.operators import drift, features, qa, splits
from landmarkflow.operators.cohort import diagnosis_match
from landmarkflow.operators.joins import exclude
from landmarkflow.plans.workflow import Workflow
from landmarkflow.sources import clinical, tables
from landmarkflow.sources.fixtures import FIXTURE_CONFIG, Fixture
from landmarkflow.sources.signals import signal_map, signal_rows


def people(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, stay_id long, anchor_year_group string")


def test_split_buckets_and_unmapped(spark):
    groups = ["2008 - 2010", "2011 - 2013", "2014 - 2016", "2017 - 2019", "2020 - 2022",
              "1990 - 1992"]
    df = people(spark, [(i, 10 * i, g) for i, g in enumerate(groups)])
    with pytest.warns(UserWarning, match="outside"):
        out = splits.assign_splits(df, check=True)
    got = {r["subject_id"]: r["split"] for r in out.collect()}
    assert got == {0: "train", 1: "train", 2: "val", 3: "test", 4: "test"}
    assert splits.load_split(out, "val").count() == 1
    with pytest.raises(ValueError):
        splits.load_split(out, "dev")
    with pytest.raises(ValueError):
        splits.load_split(df, "val")


def test_leaked_patient_raises(spark):
    bad = people(spark, [(1, 10, "2008 - 2010"), (1, 11, "2017 - 2019")])
    with pytest.raises(AssertionError, match="leakage"):
        splits.assign_splits(bad, check=True)


def summaries(spark, **change):
    base = dict(c=dict(n_stays=100, n_patients=90, min_age=18),
                l=dict(n_landmarks=300, n_stays_with_landmarks=80),
                y=dict(n_landmarks=300, prev_stage1_24h=.10, prev_stage1_48h=.15,
                       prev_stage2_24h=.04, prev_stage2_48h=.07, prev_cr_only_24h=.05,
                       prev_cr_only_48h=.09),
                k=dict(n_rolling_rows=1000, n_future_feature_rows=0,
                       n_before_window_feature_rows=0),
                b=dict(n_stays=100, n_with_baseline=70))
    for key, value in change.items():
        part, name = key.split("__")
        base[part][name] = value
    return [spark.createDataFrame([tuple(d.values())], list(d)) for d in base.values()]


def test_invariants(spark):
    qa.assert_invariants(*summaries(spark))
    with pytest.raises(AssertionError, match="after landmark_time"):
        qa.assert_invariants(*summaries(spark, k__n_future_feature_rows=1))
    with pytest.raises(AssertionError, match="stage1 48h") as err:
        qa.assert_invariants(*summaries(spark, y__prev_stage1_48h=.05, b__n_stays=99))
    assert "baseline rows" in str(err.value)  # all failures are named together
    with pytest.raises(AssertionError, match="not empty"):
        qa.assert_invariants(*summaries(spark, k__n_rolling_rows=0))


def test_drift(spark):
    rows = [(s, float(i % 7), float(i % 7) + shift, None if s == "test" else 1.0 * i)
            for s, shift in (("train", 0.0), ("val", 3.0), ("test", 6.0)) for i in range(40)]
    df = spark.createDataFrame(rows, "split string, flat double, drifted double, gone double")
    got = {(r["feature"], r["split"]): r for r in
           drift.feature_drift(df, ["flat", "drifted", "gone"]).collect()}
    assert got[("drifted", "test")]["abs_smd"] > got[("drifted", "val")]["abs_smd"] > 1
    assert got[("flat", "val")]["smd"] == pytest.approx(0) and not got[("flat", "val")]["flagged"]
    assert ("gone", "test") not in got and ("gone", "val") in got


def test_missing_flags_and_feature_columns(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 0, 1.0), (3, None, 2.0)],
                               "stay_id long, creatinine_count_6h long, creatinine_mean_6h double")
    out = features.add_missing_flags(df)
    assert [r[0] for r in out.orderBy("stay_id").select("creatinine_missing_6h").collect()] == [0, 1, 1]
    assert "creatinine_missing_6h" in out.columns and len(out.columns) == 4
    assert features.feature_columns(["stay_id", "split", "y_stage1_24h", "age", "age_group",
                                     "hours_since_icu_admit", "x"]) == ["age", "x"]


COLUMNS = [*C.META_COLUMNS, *C.LABEL_COLUMNS, "sex_male", "eth_White", "urine_output_ml_6h",
           "creatinine_max_24h", "bun_max_24h", "map_mean_12h", "fluid_input_ml_12h",
           "glucose_std_24h", "hematocrit_max_24h", "extra"]


def test_families():
    primary = features.family_columns(COLUMNS, C.FAMILIES["scorecard_primary"])
    assert "sex_male" not in primary and "extra" not in primary and "age" in primary
    assert primary[-6:] == list(C.FAMILIES["scorecard_primary"].selected[1:])
    excluded = features.family_columns(COLUMNS, C.FAMILIES["renal_excluded"])
    assert not {"creatinine_max_24h", "bun_max_24h", "urine_output_ml_6h"} & set(excluded)
    assert {"map_mean_12h", "glucose_std_24h", "eth_White"} <= set(excluded)
    with pytest.warns(UserWarning, match="missing"):
        features.family_columns(COLUMNS, C.FAMILIES["scorecard_augmented"])


def test_task_names():
    for task in C.TASKS:
        assert C.task_name(C.label_column(task)) == task
    assert C.label_column("aki_stage1_24h") == "y_stage1_24h"


def test_signal_rows(spark):
    rows = signal_rows()
    assert len(rows) == 29 and len({r[0] for r in rows}) == 24
    fahrenheit = signal_map(spark).filter("itemid = 223761").first()
    assert fahrenheit["feature_name"] == "temperature_c"
    assert (98.6 + fahrenheit["unit_offset"]) * fahrenheit["unit_multiplier"] == pytest.approx(37)


def test_exclude_and_codes(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    keys = spark.createDataFrame([(2,), (2,), (None,)], "k long")
    assert [r["k"] for r in exclude(df, keys, "k").collect()] == [1]
    codes = spark.createDataFrame([(10, "N186"), (9, "N186"), (9, "5856")],
                                  "icd_version int, icd_code string")
    assert codes.filter(diagnosis_match({10: ("N186",), 9: ("5856",)})).count() == 2


def test_staging_casts_and_layout(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    import gzip
    with gzip.open(tmp_path / "hosp/diagnoses_icd.csv.gz", "wt") as f:
        f.write("subject_id,hadm_id,seq_num,icd_code,icd_version,more\n"
                "1,2,1,0059,9,x\n3,,bad,N186,10,y\n")
    df = clinical.stage_table(spark, str(tmp_path), "diagnoses_icd", str(tmp_path / "out"))
    assert df.columns == ["subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"]
    rows = {r["subject_id"]: r for r in df.collect()}
    assert rows[1]["icd_code"] == "0059"  # a code is text
    assert rows[3]["hadm_id"] is None and rows[3]["seq_num"] is None


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 0.5)
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p")).count() == 10
    assert any("zstd" in f.name for f in (tmp_path / "p").iterdir())
    tables.write_report(df, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    tables.write_report(df.repartition(3), str(tmp_path / "many"), summary=False)
    assert len(list((tmp_path / "many").glob("*.csv"))) == 3
    manifest = tables.input_manifest(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert sum(r["n_rows"] for r in manifest) == 10
    twice = [tables.input_manifest(spark.read.parquet(str(tmp_path / "p"))).collect()
             for _ in range(2)]
    assert sorted(map(str, twice[0])) == sorted(map(str, twice[1]))
    counts = tables.table_counts({"a": df, "b": None}).collect()
    assert [r["n_rows"] for r in counts] == [10, None]


def test_full_build_writes_and_checks(spark, tmp_path):
    fx = Fixture(spark, "/root/testdata/sf0.01")
    wf = Workflow(fx.clinical, FIXTURE_CONFIG, str(tmp_path / "steps"), keep=None)
    wf.build(str(tmp_path / "reports"))
    assert (tmp_path / "steps/matrix").exists() and (tmp_path / "reports/feature_drift").exists()
    assert len(wf.matrix.columns) > 504 + 72
