"""Derived concepts: weight, baseline, hourly output, severity stages, onset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow import config as C
from landmarkflow.config import StagingConfig
from landmarkflow.functions.scalars import safe_ratio
from landmarkflow.functions.timefns import (
    DAY_US,
    HOUR_US,
    ceil_div,
    floor_div,
    hour_floor,
    micros,
)
from landmarkflow.operators.grid import hour_span, hourly_grid
from landmarkflow.operators.joins import asof_join, densify, events_in_episode
from landmarkflow.operators.windows import trailing_min, trailing_sums


def valid_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Not null and inside the closed range."""
    return df.filter(F.col(column).isNotNull() & F.col(column).between(F.lit(lo), F.lit(hi)))


def item_filter(df: DataFrame, items, column: str = "itemid") -> DataFrame:
    """Rows of the listed items (reaches the Parquet scan as a pushed filter)."""
    return df.filter(F.col(column).isin(*items))


def first_available(*columns) -> Column:
    return F.coalesce(*[F.col(c) for c in columns])


def episode_weight(episodes: DataFrame, inputevents: DataFrame, chartevents: DataFrame,
                   cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Best available weight per stay in kg: mean of input rows, else the mean of
    the kg mean and the converted lb mean, else NULL."""
    (lo, hi), (lb_lo, lb_hi) = cfg.weight_kg_range, cfg.weight_lb_range
    primary = (valid_range(inputevents, "patientweight", lo, hi)
               .groupBy("stay_id").agg(F.avg("patientweight").alias("_w_input")))
    kg = F.col("itemid").isin(*C.WEIGHT_KG_ITEMS) & F.col("valuenum").between(lo, hi)
    lb = F.col("itemid").isin(*C.WEIGHT_LB_ITEMS) & F.col("valuenum").between(lb_lo, lb_hi)
    means = (item_filter(chartevents, C.WEIGHT_KG_ITEMS + C.WEIGHT_LB_ITEMS).filter(kg | lb)
             .groupBy("stay_id").agg(
                 F.avg(F.when(kg, F.col("valuenum"))).alias("_kg"),
                 F.avg(F.when(lb, F.col("valuenum") / C.LB_PER_KG)).alias("_lb")))
    both = F.when(F.col("_kg").isNotNull() & F.col("_lb").isNotNull(),
                  (F.col("_kg") + F.col("_lb")) / 2.0).otherwise(F.coalesce("_kg", "_lb"))
    fallback = means.select("stay_id", both.alias("_w_chart"))
    return (episodes.select("stay_id").join(primary, "stay_id", "left")
            .join(fallback, "stay_id", "left")
            .select("stay_id", first_available("_w_input", "_w_chart").alias("weight_kg")))


def creatinine(labevents: DataFrame, cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Valid measurements of the staged lab."""
    lo, hi = cfg.creatinine_range
    rows = valid_range(item_filter(labevents, (50912,)), "valuenum", lo, hi)
    return rows.select("subject_id", "hadm_id", "charttime",
                       F.col("valuenum").alias("creatinine_mg_dl"))


def baseline(episodes: DataFrame, measurements: DataFrame,
             cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Lowest measurement of the patient before the stay: short look-back, then long.

    Both ranges are ``[intime - days, intime - gap]``, closed.
    """
    gap = cfg.baseline_gap_minutes * 60_000_000
    short, long = cfg.baseline_days
    asked = episodes.select("stay_id", "subject_id", "hadm_id", "intime").withColumn(
        "_ask", F.col("intime") - F.expr(f"INTERVAL '{cfg.baseline_gap_minutes}' MINUTE"))
    spans = {f"baseline_{short}d": short * DAY_US - gap, f"baseline_{long}d": long * DAY_US - gap}
    lows = trailing_min(asked, measurements, "subject_id", "_ask", "charttime",
                        "creatinine_mg_dl", spans)
    out = asked.join(lows, ["subject_id", "_ask"], "left")
    return out.select("stay_id", "subject_id", "hadm_id", "intime", *spans,
                      first_available(*spans).alias("baseline_mg_dl"))


def signed_hourly_sum(outputevents: DataFrame, items=C.URINE_ITEMS,
                      negative_items=C.IRRIGANT_ITEMS) -> DataFrame:
    """Net output per stay and clock hour, floored at 0; the hour is its start."""
    value = F.when(F.col("itemid").isin(*negative_items), -F.col("value")).otherwise(
        F.col("value"))
    return (item_filter(outputevents, items).filter(F.col("value") >= 0)
            .groupBy("stay_id", hour_floor("charttime").alias("uo_hour"))
            .agg(F.greatest(F.coalesce(F.sum(value), F.lit(0.0)), F.lit(0.0)).alias("uo_ml")))


def stage_by_ratio(value: Column, reference: Column, trailing: Column,
                   cfg: StagingConfig = StagingConfig()) -> Column:
    """Severity from the ratio to a reference and the rise over the trailing minimum.

    The high absolute level counts only together with a rise, so a stable high
    value is no stage 3. The order of the rungs matters.
    """
    c1, c2, c3 = cfg.ratio_cuts
    ratio = safe_ratio(value, reference)
    rise = (value - trailing) >= cfg.abs_rise
    return (F.when((value >= cfg.abs_level) & rise, 3)
            .when(ratio >= c3, 3).when(ratio >= c2, 2).when(ratio >= c1, 1)
            .when(rise, 1).otherwise(0))


def measured(episodes: DataFrame, measurements: DataFrame,
             cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Measurements taken within 30 days of the start of each stay."""
    return events_in_episode(
        episodes.select("stay_id", "subject_id", F.col("hadm_id"), "intime"),
        measurements.select("subject_id", "charttime", "creatinine_mg_dl"),
        cfg.episode_days)


def ratio_stages(episodes: DataFrame, measurements: DataFrame, base: DataFrame,
                 cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Stage at every measurement taken within 30 days of the stay's start."""
    return staged_by_ratio(measured(episodes, measurements, cfg), base, cfg)


def staged_by_ratio(during: DataFrame, base: DataFrame,
                    cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """:func:`ratio_stages` of the :func:`measured` rows (read several times)."""
    spans = {"cr_min_48h": cfg.rise_hours * HOUR_US, "cr_min_7d": cfg.fallback_hours * HOUR_US}
    lows = trailing_min(during, during, "stay_id", "charttime", "charttime", "creatinine_mg_dl",
                        spans)
    reference = base.select("stay_id", F.col("baseline_mg_dl").alias("baseline"))
    rows = (during.join(lows, ["stay_id", "charttime"]).join(reference, "stay_id", "left")
            .withColumn("ref_baseline", first_available("baseline", "cr_min_7d")))
    stage = stage_by_ratio(F.col("creatinine_mg_dl"), F.col("ref_baseline"),
                           F.col("cr_min_48h"), cfg)
    return rows.select("stay_id", "subject_id", "hadm_id", "charttime", "creatinine_mg_dl",
                       "baseline", "cr_min_48h", "cr_min_7d", "ref_baseline",
                       stage.alias("kdigo_cr_stage"))


def coverage_gated_rate(total: str, observed: str, size: int, least: int,
                        weight: str = "weight_kg") -> Column:
    """Rate per weight and hour, NULL below the coverage minimum or without weight."""
    return F.when(F.col(weight).isNotNull() & (F.col(observed) >= least),
                  F.col(total) / (F.col(weight) * size))


def stage_by_rate(cfg: StagingConfig = StagingConfig(), weight: str = "weight_kg") -> Column:
    """Severity from sustained low rates; NULL without a weight."""
    w1, w2, w3 = cfg.rate_windows
    m1, m2, m3 = cfg.rate_min_observed

    def rate(w):
        return F.col(f"uo_{w}h_ml") / (F.col(weight) * w)

    anuria = ((F.col(f"n_obs_{cfg.anuria_window}h") >= cfg.anuria_min_observed)
              & (F.col(f"uo_{cfg.anuria_window}h_ml") == 0))
    low3 = (F.col(f"n_obs_{w3}h") >= cfg.anuria_min_observed) & (rate(w3) < cfg.very_low_rate)
    low2 = (F.col(f"n_obs_{w2}h") >= m2) & (rate(w2) < cfg.low_rate)
    low1 = (F.col(f"n_obs_{w1}h") >= m1) & (rate(w1) < cfg.low_rate)
    return (F.when(F.col(weight).isNull(), F.lit(None).cast("int"))
            .when(anuria, 3).when(low3, 3).when(low2, 2).when(low1, 1).otherwise(0))


def rate_stages(episodes: DataFrame, hourly: DataFrame, weight: DataFrame,
                cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Stage at every hour of the stay from trailing 6/12/24-hour output."""
    grid = hourly_grid(episodes, cfg.episode_days, "uo_hour")
    dense = densify(grid.drop("subject_id"), hourly, ["stay_id", "uo_hour"], "uo_ml", "has_uo")
    sums = trailing_sums(dense, "stay_id", "uo_hour",
                         {"uo_{}h_ml": "uo_ml", "n_obs_{}h": "has_uo"}, cfg.rate_windows)
    rows = sums.join(weight, "stay_id", "left")
    totals = [f"uo_{w}h_ml" for w in cfg.rate_windows]
    counts = [f"n_obs_{w}h" for w in cfg.rate_windows]
    rates = [coverage_gated_rate(t, n, w, m).alias(f"uo_rate_{w}h") for t, n, w, m in
             zip(totals, counts, cfg.rate_windows, cfg.rate_min_observed, strict=True)]
    return rows.select("stay_id", "uo_hour", "weight_kg", *totals, *counts, *rates,
                       stage_by_rate(cfg).alias("kdigo_uo_stage"))


def combine_stages(a: str, b: str) -> Column:
    """Larger of two stages, a missing one counting as 0."""
    return F.greatest(F.coalesce(F.col(a), F.lit(0)), F.coalesce(F.col(b), F.lit(0)))


def combined_stages(by_rate: DataFrame, by_ratio: DataFrame,
                    cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """Hourly stage: the carried-forward ratio stage against the hour's rate stage."""
    hours = by_rate.select("stay_id", F.col("uo_hour").alias("t_hour"), "kdigo_uo_stage")
    rows = asof_join(hours, by_ratio.select("stay_id", "charttime", "kdigo_cr_stage"), "stay_id",
                     "t_hour", "charttime", "kdigo_cr_stage", cfg.carry_hours)
    return rows.select("stay_id", "t_hour", "kdigo_cr_stage", "kdigo_uo_stage",
                       combine_stages("kdigo_cr_stage", "kdigo_uo_stage").alias("kdigo_stage"))


def stage_changes(episodes: DataFrame, hourly: DataFrame, weight: DataFrame, by_ratio: DataFrame,
                  cfg: StagingConfig = StagingConfig()) -> DataFrame:
    """The rows of :func:`combined_stages` at the hours where a stage can change.

    These are the stay's first hour, an hour with output, the hours at which it leaves a
    trailing window, the first hour after a measurement and the one at which that is too
    old. Between two of them every hour has the earlier one's stages, so the first hour at
    a level is among them, and the rows grow with the events, not with the hours stayed.
    Events are reduced per hour first, so a stay has at most a few rows per hour.
    """
    span = hour_span(episodes, cfg.episode_days).select(
        "stay_id", "_a", floor_div(micros("_a"), HOUR_US).alias("_first"),
        floor_div(micros("_z"), HOUR_US).alias("_last"))
    output = hourly.select("stay_id", floor_div(micros("uo_hour"), HOUR_US).alias("_h"), "uo_ml")
    at = micros("charttime")
    measured = (by_ratio.filter(F.col("charttime").isNotNull())
                .groupBy("stay_id", ceil_div(at, HOUR_US).alias("_h"))
                .agg(F.max(F.struct(at.alias("_rt"), F.col("kdigo_cr_stage").alias("_rv")))
                     .alias("_hit")))
    h, first, hit = F.col("_h"), F.col("_first"), F.col("_hit")
    stale = floor_div(hit["_rt"], HOUR_US) + F.lit(cfg.carry_hours + 1)
    marks = F.when(hit.isNotNull(), F.array(F.greatest(h, first), first, stale)).otherwise(
        F.array(h, first, *[h + F.lit(w) for w in cfg.rate_windows]))
    points = (span.join(output.unionByName(measured, allowMissingColumns=True), "stay_id", "left")
              .select("stay_id", "_a", "_first", "_last", "uo_ml", "_hit",
                      F.posexplode(marks).alias("_pos", "_at"))
              .filter(F.col("_at").between(first, F.col("_last")))
              .groupBy("stay_id", "_at").agg(
                  F.first("_a").alias("_a"), F.first("_first").alias("_first"),
                  F.max(F.when(F.col("_pos") == 0, F.col("uo_ml"))).alias("uo_ml"),
                  F.max(F.when(F.col("_pos") == 0, hit)).alias("_hit")))

    order = Window.partitionBy("stay_id").orderBy("_at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trailing = {w: order.rangeBetween(-(w - 1), 0) for w in cfg.rate_windows}
    ml, seen = F.coalesce("uo_ml", F.lit(0.0)), F.col("uo_ml").isNotNull().cast("int")
    rows = points.select(
        "stay_id", "_at",
        (F.col("_a") + F.make_dt_interval(hours=(F.col("_at") - first).cast("int")))
        .alias("t_hour"),
        F.last("_hit", ignorenulls=True).over(so_far).alias("_hit"),
        *[F.sum(ml).over(frame).alias(f"uo_{w}h_ml") for w, frame in trailing.items()],
        *[F.sum(seen).over(frame).alias(f"n_obs_{w}h") for w, frame in trailing.items()])
    fresh = hit["_rt"] >= (F.col("_at") - F.lit(cfg.carry_hours)) * F.lit(HOUR_US)
    return (rows.join(weight, "stay_id", "left")
            .select("stay_id", "t_hour", F.when(fresh, hit["_rv"]).alias("kdigo_cr_stage"),
                    stage_by_rate(cfg).alias("kdigo_uo_stage"))
            .withColumn("kdigo_stage", combine_stages("kdigo_cr_stage", "kdigo_uo_stage")))


def onset(stages: DataFrame, levels=(1, 2, 3)) -> DataFrame:
    """First hour at or above each level, and what drove the first one."""
    by_ratio = F.coalesce(F.col("kdigo_cr_stage"), F.lit(0)) >= 1
    by_rate = F.coalesce(F.col("kdigo_uo_stage"), F.lit(0)) >= 1
    source = (F.when(by_ratio & ~by_rate, "creatinine").when(~by_ratio & by_rate, "urine_output")
              .when(by_ratio & by_rate, "both"))
    reached = F.col("kdigo_stage") >= 1
    return stages.groupBy("stay_id").agg(
        *[F.min(F.when(F.col("kdigo_stage") >= n, F.col("t_hour"))).alias(f"onset_stage{n}_time")
          for n in levels],
        F.min_by(F.when(reached, source), F.when(reached, F.col("t_hour")))
        .alias("stage1_source"))
