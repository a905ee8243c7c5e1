"""Hospital-shaped views over the driver's event, order and customer tables.

``events`` becomes five-day stays with lab, chart, input and output rows;
``customer`` the patients; ``orders`` the coded diagnoses; ``lineitem`` scored
predictions. The column layouts are those of ``sources.clinical``, so all
operators run unchanged on either.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmarkflow.config import Config, StagingConfig
from landmarkflow.functions.timefns import DAY_US, micros

YEAR_GROUPS = ("2008 - 2010", "2011 - 2013", "2014 - 2016", "2017 - 2019", "2020 - 2022",
               "2005 - 2007")  # the last one is in no split

SEGMENT_GROUPS = {"White": ("MACHINERY",), "Black": ("BUILDING",), "Hispanic": ("AUTOMOBILE",),
                  "Asian": ("FURNITURE",), "Other": ("HOUSEHOLD",)}

# events are sparse (about 2 per user and day): fewer observed hours are asked for
FIXTURE_CONFIG = replace(
    Config(),
    staging=StagingConfig(rate_min_observed=(2, 2, 3), anuria_min_observed=3),
    ethnicity_groups=SEGMENT_GROUPS)


@dataclass(frozen=True)
class ClinicalTables:
    """The staged tables every workflow step reads."""

    patients: DataFrame
    admissions: DataFrame
    diagnoses_icd: DataFrame
    labevents: DataFrame
    icustays: DataFrame
    chartevents: DataFrame
    inputevents: DataFrame
    outputevents: DataFrame


def _block(days: int):
    index = F.floor((F.dayofmonth("ts") - 1) / F.lit(days)).cast("bigint")
    return F.col("user_id") * 10 + index


class Fixture:
    """Views over one scale-factor folder; nothing runs until a job needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("subject_id"), _block(15).alias("hadm_id"),
            _block(5).alias("stay_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
            "event_type", "value")

    @cached_property
    def icustays(self) -> DataFrame:
        length = micros("outtime") - micros("intime")
        return (self.events.groupBy("subject_id", "hadm_id", "stay_id")
                .agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
                .withColumn("first_careunit", F.lit("UNIT"))
                .withColumn("los", length / float(DAY_US)))

    @cached_property
    def admissions(self) -> DataFrame:
        span = (self.events.groupBy("subject_id", "hadm_id")
                .agg(F.min("ts").alias("admittime"), F.max("ts").alias("dischtime")))
        race = self.table("customer").select(F.col("c_custkey").alias("subject_id"),
                                             F.col("c_mktsegment").alias("race"))
        return (span.join(race, "subject_id")
                .withColumn("deathtime", F.lit(None).cast("timestamp_ntz")))

    @cached_property
    def patients(self) -> DataFrame:
        group = F.element_at(F.array(*[F.lit(g) for g in YEAR_GROUPS]),
                             (F.col("c_nationkey") % 6 + 1).cast("int"))
        return self.table("customer").select(
            F.col("c_custkey").alias("subject_id"),
            F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
            (F.lit(10) + F.col("c_custkey") % 80).cast("int").alias("anchor_age"),
            F.lit(2150).alias("anchor_year"), group.alias("anchor_year_group"),
            F.lit(None).cast("date").alias("dod"))

    @cached_property
    def diagnoses_icd(self) -> DataFrame:
        old = F.col("o_orderstatus") == "F"
        return self.table("orders").select(
            F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
            F.when(F.col("o_totalprice") > 480000, F.when(old, "5856").otherwise("N186"))
            .otherwise("I10").alias("icd_code"),
            F.when(old, 9).otherwise(10).alias("icd_version"))

    @cached_property
    def labevents(self) -> DataFrame:
        purchase = F.col("event_type") == "purchase"
        return (self.events.filter(F.col("event_type").isin("purchase", "error"))
                .select(F.col("event_id").alias("labevent_id"), "subject_id", "hadm_id",
                        F.when(purchase, 50912).otherwise(50931).cast("bigint").alias("itemid"),
                        F.col("ts").alias("charttime"),
                        F.when(purchase, F.col("value") / 50.0).otherwise(F.col("value"))
                        .alias("valuenum")))

    @cached_property
    def chartevents(self) -> DataFrame:
        kind, eid = F.col("event_type"), F.col("event_id")
        items = (F.when(kind == "click", F.when(eid % 7 == 0, F.array(F.lit(220045), F.lit(224639)))
                        .otherwise(F.array(F.lit(220045))))
                 .when(kind == "view", F.array(F.lit(220052), F.lit(226531)))
                 .when(kind == "error", F.when(eid % 2 == 0, F.array(F.lit(223761), F.lit(225792)))
                       .otherwise(F.array(F.lit(223761)))))
        return (self.events.filter(kind.isin("click", "view", "error"))
                .select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("charttime"),
                        F.explode(items.cast("array<bigint>")).alias("itemid"),
                        F.col("value").alias("valuenum")))

    @cached_property
    def inputevents(self) -> DataFrame:
        eid = F.col("event_id")
        item = F.element_at(F.array(*[F.lit(i) for i in (221906, 221794, 222315, 225158)]),
                            (eid % 4 + 1).cast("int"))
        unit = F.element_at(F.array(F.lit("ml"), F.lit("mL"), F.lit("mg")),
                            (eid % 3 + 1).cast("int"))
        return (self.events.filter(F.col("event_type") == "signup")
                .select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("starttime"),
                        (F.col("ts") + F.make_dt_interval(
                            mins=F.floor("value").cast("int"))).alias("endtime"),
                        item.cast("bigint").alias("itemid"), F.col("value").alias("amount"),
                        unit.alias("amountuom"), F.col("value").alias("patientweight")))

    @cached_property
    def outputevents(self) -> DataFrame:
        kind = F.col("event_type")
        return (self.events.filter(kind.isin("view", "click", "error"))
                .select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("charttime"),
                        F.when(kind == "view", 226559).when(kind == "click", 226560)
                        .otherwise(227488).cast("bigint").alias("itemid"), "value"))

    @cached_property
    def clinical(self) -> ClinicalTables:
        return ClinicalTables(self.patients, self.admissions, self.diagnoses_icd, self.labevents,
                              self.icustays, self.chartevents, self.inputevents,
                              self.outputevents)

    @cached_property
    def scored(self) -> DataFrame:
        """Scored rows with 50 tied score values and patient attributes."""
        year = F.year("o_orderdate")
        extra = ("l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        rows = (self.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                              *extra)
                .join(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
                      F.col("l_orderkey") == F.col("o_orderkey")))
        return rows.select(
            "l_orderkey", "l_linenumber", *extra, F.col("o_custkey").alias("subject_id"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
            (F.col("l_quantity") / 51.0).alias("p"),
            F.when(year <= 1998, "train").when(year == 1999, "val").otherwise("test")
            .alias("split"))
