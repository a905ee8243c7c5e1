"""Typed scans of the hospital CSV tables and their one-time staging to Parquet.

Schemas are fixed: inference would cost a full extra pass, and a gzip file is
one task however large, so ``stage_table`` reads each file once, casts, spreads
the rows and writes Parquet for everything downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: table layouts (column, staged type) -------------------------
_ID, _NUM, _STR, _TS, _DATE, _INT = "bigint", "double", "string", "timestamp_ntz", "date", "int"

TABLES = {
    "patients": ("hosp/patients.csv.gz", (
        ("subject_id", _ID), ("gender", _STR), ("anchor_age", _INT), ("anchor_year", _INT),
        ("anchor_year_group", _STR), ("dod", _DATE))),
    "admissions": ("hosp/admissions.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("admittime", _TS), ("dischtime", _TS),
        ("deathtime", _TS), ("admission_type", _STR), ("admission_location", _STR),
        ("discharge_location", _STR), ("insurance", _STR), ("language", _STR),
        ("marital_status", _STR), ("race", _STR), ("hospital_expire_flag", _INT))),
    "labevents": ("hosp/labevents.csv.gz", (
        ("labevent_id", _ID), ("subject_id", _ID), ("hadm_id", _ID), ("specimen_id", _ID),
        ("itemid", _ID), ("charttime", _TS), ("storetime", _TS), ("valuenum", _NUM),
        ("valueuom", _STR), ("ref_range_lower", _NUM), ("ref_range_upper", _NUM),
        ("flag", _STR))),
    "d_labitems": ("hosp/d_labitems.csv.gz", (
        ("itemid", _ID), ("label", _STR), ("fluid", _STR), ("category", _STR))),
    "diagnoses_icd": ("hosp/diagnoses_icd.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("seq_num", _INT), ("icd_code", _STR),
        ("icd_version", _INT))),
    "omr": ("hosp/omr.csv.gz", (
        ("subject_id", _ID), ("chartdate", _DATE), ("seq_num", _INT), ("result_name", _STR),
        ("result_value", _STR))),
    "icustays": ("icu/icustays.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("stay_id", _ID), ("first_careunit", _STR),
        ("last_careunit", _STR), ("intime", _TS), ("outtime", _TS), ("los", _NUM))),
    "d_items": ("icu/d_items.csv.gz", (
        ("itemid", _ID), ("label", _STR), ("abbreviation", _STR), ("linksto", _STR),
        ("category", _STR), ("unitname", _STR), ("param_type", _STR))),
    "chartevents": ("icu/chartevents.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("stay_id", _ID), ("caregiver_id", _ID),
        ("charttime", _TS), ("storetime", _TS), ("itemid", _ID), ("value", _STR),
        ("valuenum", _NUM), ("valueuom", _STR), ("warning", _INT))),
    "inputevents": ("icu/inputevents.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("stay_id", _ID), ("caregiver_id", _ID),
        ("starttime", _TS), ("endtime", _TS), ("storetime", _TS), ("itemid", _ID),
        ("amount", _NUM), ("amountuom", _STR), ("rate", _NUM), ("rateuom", _STR),
        ("orderid", _ID), ("linkorderid", _ID), ("ordercategoryname", _STR),
        ("secondaryordercategoryname", _STR), ("ordercomponenttypedescription", _STR),
        ("ordercategorydescription", _STR), ("patientweight", _NUM), ("totalamount", _NUM),
        ("totalamountuom", _STR), ("isopenbag", _INT), ("continueinnextdept", _INT),
        ("statusdescription", _STR), ("originalamount", _NUM), ("originalrate", _NUM))),
    "outputevents": ("icu/outputevents.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("stay_id", _ID), ("caregiver_id", _ID),
        ("charttime", _TS), ("storetime", _TS), ("itemid", _ID), ("value", _NUM),
        ("valueuom", _STR))),
    "procedureevents": ("icu/procedureevents.csv.gz", (
        ("subject_id", _ID), ("hadm_id", _ID), ("stay_id", _ID), ("starttime", _TS),
        ("endtime", _TS), ("itemid", _ID), ("value", _NUM), ("valueuom", _STR))),
}
# --- end of fixed values -------------------------------------------------------


def cast_columns(df: DataFrame, types: dict) -> DataFrame:
    """Cast the named columns; blank or malformed text becomes NULL.

    One projection: columns not named are passed through unchanged.
    """
    return df.select(*[
        F.trim(F.col(c).cast("string")).try_cast(types[c]).alias(c) if c in types else F.col(c)
        for c in df.columns])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one raw CSV table with its fixed layout, as staged types.

    The header gives the column order, every field arrives as text and is cast
    with ``try_cast``; only the layout's columns are kept.
    """
    path, layout = TABLES[name]
    raw = spark.read.csv(f"{root}/{path}", header=True)
    wanted = [c for c, _ in layout]
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise ValueError(f"{name}: columns {missing} not in {path}")
    return cast_columns(raw.select(*wanted), dict(layout))


def stage_table(spark: SparkSession, root: str, name: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """Write one table as Parquet, spread evenly over files, and read it back.

    Rows are rebalanced to even files whatever their patient: one patient
    holding a third of the rows would otherwise fill one file.
    """
    from landmarkflow.sources.tables import write_parquet

    df = read_table(spark, root, name)
    df = df.repartition(partitions) if partitions else df.hint("rebalance")
    write_parquet(df, f"{out}/{name}")
    return spark.read.parquet(f"{out}/{name}")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """Zero rows with the staged layout of ``name``."""
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in TABLES[name][1]))
