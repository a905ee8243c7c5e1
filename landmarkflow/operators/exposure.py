"""Treatment exposure per landmark from four event sources in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow import config as C
from landmarkflow.config import FeatureConfig, LandmarkConfig
from landmarkflow.functions.timefns import HOUR_US, micros
from landmarkflow.operators.grid import grid_starts, place_on_grid


def exposure_events(inputevents: DataFrame, chartevents: DataFrame, outputevents: DataFrame
                    ) -> DataFrame:
    """The contributing rows as ``(stay_id, kind, start_us, end_us, amount)``.

    An input row can count twice (as a drug and as fluid), so its kinds are
    exploded from one scan. The filters are on stored columns, so scans can use them.
    """
    def tag(condition, name):
        return F.when(condition, F.lit(name))

    none = F.lit(None).cast("double")
    item = F.col("itemid")
    kinds = F.array_compact(F.array(
        tag(item.isin(*C.VASOPRESSOR_ITEMS), "vaso"),
        tag(item.isin(*C.LOOP_DIURETIC_ITEMS), "loop"),
        tag(F.col("amountuom").isin(*C.FLUID_UNITS), "fluid")))
    wanted = item.isin(*C.VASOPRESSOR_ITEMS, *C.LOOP_DIURETIC_ITEMS) | F.col("amountuom").isin(
        *C.FLUID_UNITS)
    given = (inputevents.filter(wanted).select("stay_id", "starttime", "endtime", "amount",
                                F.explode(kinds).alias("kind"))
             .select("stay_id", "kind", micros("starttime").alias("start_us"),
                     F.when(F.col("kind") == "vaso", micros("endtime"))
                     .otherwise(micros("starttime")).alias("end_us"), "amount"))
    vent = (chartevents.filter(item.isin(*C.MECH_VENT_ITEMS))
            .select("stay_id", F.lit("vent").alias("kind"), micros("charttime").alias("start_us"),
                    micros("charttime").alias("end_us"), none.alias("amount")))
    signed = F.when(item.isin(*C.IRRIGANT_ITEMS), -F.col("value")).otherwise(F.col("value"))
    out = (outputevents.filter(item.isin(*C.URINE_ITEMS))
           .select("stay_id", F.lit("urine").alias("kind"), micros("charttime").alias("start_us"),
                   micros("charttime").alias("end_us"), signed.alias("amount")))
    return given.unionByName(vent).unionByName(out).filter(
        F.col("start_us").isNotNull() & F.col("end_us").isNotNull())


def treatment_block(lm: DataFrame, inputevents: DataFrame, chartevents: DataFrame,
                    outputevents: DataFrame, cfg: FeatureConfig = FeatureConfig(),
                    lm_cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Exposure flags and windowed sums, one row per landmark.

    A running drug counts when it overlaps the look-back (open at its far end),
    the others when they start in the closed look-back. No fluid gives NULL, no
    output gives 0; net output is floored at 0.
    """
    rows = exposure_events(inputevents, chartevents, outputevents)
    hits = exposure_hits(lm, rows, cfg, lm_cfg)
    age = F.col("landmark_us") - F.col("start_us")
    kind = F.col("kind")
    span, windows = cfg.exposure_hours, cfg.windows
    flags = {"vaso": f"vasopressor_any_{span}h", "loop": f"loop_diuretic_{span}h",
             "vent": f"mech_vent_{span}h"}
    aggs = [F.max(F.when(kind == k, 1)).alias(n) for k, n in flags.items()]
    for k, prefix in (("fluid", "fluid_input_ml"), ("urine", "urine_output_ml")):
        aggs += [F.sum(F.when((kind == k) & (age <= w * HOUR_US), F.col("amount")))
                 .alias(f"{prefix}_{w}h") for w in windows]
    sums = hits.groupBy("stay_id", "landmark_idx").agg(*aggs)
    keys = lm.select("stay_id", "landmark_idx", "landmark_time")
    return keys.join(sums, ["stay_id", "landmark_idx"], "left").select(
        *keys.columns,
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in flags.values()],
        *[F.col(f"fluid_input_ml_{w}h") for w in windows],
        *[F.greatest(F.coalesce(F.col(f"urine_output_ml_{w}h"), F.lit(0.0)), F.lit(0.0))
          .alias(f"urine_output_ml_{w}h") for w in windows])


def exposure_hits(lm: DataFrame, rows: DataFrame, cfg: FeatureConfig, lm_cfg: LandmarkConfig
                  ) -> DataFrame:
    """Exposure rows repeated for the landmarks they may count at.

    The open far end of running drugs becomes a closed one by taking one
    microsecond off, so one placement serves all kinds.
    """
    far = max(cfg.exposure_hours, *cfg.windows)
    reach = F.when(F.col("kind") == "vaso",
                   F.col("end_us") + F.lit(cfg.exposure_hours * HOUR_US - 1)).when(
        F.col("kind").isin("loop", "vent"),
        F.col("start_us") + F.lit(cfg.exposure_hours * HOUR_US)).otherwise(
        F.col("start_us") + F.lit(far * HOUR_US))
    return place_on_grid(rows, grid_starts(lm), F.col("start_us"), reach, True, lm_cfg)
