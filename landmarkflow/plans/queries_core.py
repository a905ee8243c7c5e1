"""Queries on grids, joins, windows and concepts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landmarkflow.functions.scalars import (bin_index, range_label_column, raw_logit, safe_ratio,
                                            scaled_round)
from landmarkflow.functions.timefns import HOUR_US, hour_boundaries, hour_floor, hours, micros
from landmarkflow.operators import cohort as co
from landmarkflow.operators import concepts as cc
from landmarkflow.operators import grid as gr
from landmarkflow.operators import joins as jn
from landmarkflow.operators import rolling as ro
from landmarkflow.operators.windows import trailing_min, trailing_sums
from landmarkflow.plans.registry import query
from landmarkflow.sources import tables as tb
from landmarkflow.sources.clinical import TABLES, cast_columns, stage_table
from landmarkflow.sources.incremental import stage_changes, update_step
from landmarkflow.sources.signals import signal_items, signal_map
from landmarkflow.sources.tables import run_folder

LM_KEYS = ("stay_id", "landmark_time")


# --- sources -------------------------------------------------------------------
@query("s1_staged_csv", 6)
def _(c):
    """Stays written as raw gzip CSV, scanned with the fixed layout, staged as Parquet."""
    stays = c.fx.icustays.withColumn("last_careunit", F.lit("")).withColumn(
        "unused", F.lit("dropped by the layout"))
    raw = run_folder(c.spark)
    text = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    (stays.withColumn("intime", F.date_format("intime", text))
     .withColumn("outtime", F.date_format("outtime", text)).write.option("header", True)
     .option("compression", "gzip").csv(f"{raw}/icu/icustays.csv.gz"))
    return stage_table(c.spark, raw, "icustays", f"{raw}/staged")


@query("s9_incremental_stage", 6)
def _(c):
    """Output rows staged from raw files, one kind of them in files that come later; the
    sums per stay are brought up to date for the patients of the later files."""
    rows, names = c.fx.outputevents, [n for n, _ in TABLES["outputevents"][1]]
    rows = rows.withColumn("charttime", F.date_format("charttime", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    raw, late = run_folder(c.spark), F.col("itemid") == 227488
    text = rows.select(*[F.col(n) if n in rows.columns else F.lit("").alias(n) for n in names])

    def sums(t):
        return t["outputevents"].groupBy("subject_id", "stay_id").agg(
            F.count("*").alias("n"), F.sum("value").alias("total_ml"),
            F.max("charttime").alias("last_time"))

    for part in (~late, late):
        (text.filter(part).write.mode("append").option("header", True)
         .option("compression", "gzip").csv(f"{raw}/{TABLES['outputevents'][0]}"))
        staged = stage_changes(c.spark, raw, "outputevents", f"{raw}/staged")
        table = update_step(c.spark, "stay_sums", f"{raw}/staged", sums, {"outputevents": staged})
    return table


@query("s3_parquet_sink", 9)
def _(c):
    out = f"{run_folder(c.spark)}/creatinine"
    tb.write_parquet(c.wf.creatinine, out)
    return tb.read_parquet(c.spark, out)


@query("s5_report_sink", 6)
def _(c):
    report = c.fx.events.groupBy("event_type").agg(F.count("*").alias("n"),
                                                   F.round(F.sum("value"), 2).alias("total"))
    out = f"{run_folder(c.spark)}/report"
    tb.write_report(report, out)
    return c.spark.read.csv(out, header=True, schema="event_type string, n bigint, total double")


@query("s8_materialised_table")
def _(c):
    folder = run_folder(c.spark)
    tb.materialize(c.wf.stay_landmarks.limit(0), "landmarks", folder)  # replaced next
    return tb.materialize(c.wf.stay_landmarks.select(*LM_KEYS), "landmarks", folder)


@query("s2_cast_on_stage")
def _(c):
    text = c.fx.table("orders").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("placed_at"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_custkey").cast("string"))
        .alias("custkey"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice")
                                                             .cast("string")).alias("price"))
    return cast_columns(text, {"placed_at": "timestamp_ntz", "custkey": "bigint",
                               "price": "double"})


@query("s4_parquet_scan")
def _(c):
    return tb.read_parquet(c.spark, f"{c.fx.dir}/events.parquet").select(
        "event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("s6_signal_lookup", 9)
def _(c):
    """The lookup relation, used: rows and mean raw value per (feature, item)."""
    labs, charts = c.fx.labevents, c.fx.chartevents
    signals = signal_map(c.spark)
    mapped = jn.union_events(
        jn.map_signals(charts, signals, "chartevents").select("feature_name", "itemid",
                                                              "valuenum"),
        jn.map_signals(labs, signals, "labevents").select("feature_name", "itemid", "valuenum"))
    used = mapped.groupBy("feature_name", "itemid").agg(F.count("*").alias("n_rows"))
    return signals.join(used, ["feature_name", "itemid"], "left").select(
        "feature_name", "source", "itemid", "valid_low", "valid_high", "unit_multiplier",
        "unit_offset", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("s7_window_list")
def _(c):
    lm = c.wf.stay_landmarks.select(*LM_KEYS)
    return lm.withColumn("window_h", F.explode(tb.values_column([6, 12, 24])))


@query("s9_input_manifest")
def _(c):
    return tb.input_manifest(c.fx.table("events"))


@query("s10_table_counts")
def _(c):
    return tb.table_counts({"icustays": c.fx.icustays, "labevents": c.fx.labevents,
                            "chartevents": c.fx.chartevents, "omr": None,
                            "diagnoses_icd": c.fx.diagnoses_icd})


@query("s11_run_columns")
def _(c):
    summary = c.fx.icustays.agg(F.count("*").alias("n_stays"))
    return tb.with_run_columns(summary, c.cfg)


# --- projection, filter, predicate ------------------------------------------------
@query("p1_static_columns")
def _(c):
    return co.base_cohort(c.fx.icustays, c.fx.patients, c.fx.admissions, c.cfg.cohort).select(
        "stay_id", "subject_id", "hadm_id", "sex", "age", "anchor_year_group", "ethnicity",
        "intime", "outtime", "admittime", "dischtime")


@query("p2_valid_range", 9)
def _(c):
    return cc.creatinine(c.fx.labevents, c.cfg.staging)


@query("p3_item_filter")
def _(c):
    from landmarkflow.config import VASOPRESSOR_ITEMS
    return cc.item_filter(c.fx.inputevents, VASOPRESSOR_ITEMS).select(
        "stay_id", "starttime", "endtime", "itemid")


@query("p4_unit_conversion", 9)
def _(c):
    rows = jn.map_signals(c.fx.chartevents, signal_map(c.spark), "chartevents",
                          signal_items("chartevents"))
    return ro.convert_units(rows).select("stay_id", "charttime", "itemid", "feature_name", "value")


@query("p5_stage_by_ratio", 9)
def _(c):
    return c.wf.ratio_stages.select("stay_id", "charttime", "creatinine_mg_dl", "ref_baseline",
                                    "kdigo_cr_stage")


@query("p6_stage_by_rate")
def _(c):
    return c.wf.rate_stages.select("stay_id", "uo_hour", "kdigo_uo_stage")


@query("p7_gated_rate", 9)
def _(c):
    return c.wf.rate_stages.select("stay_id", "uo_hour", "uo_rate_6h", "uo_rate_12h",
                                   "uo_rate_24h")


@query("p8_combined_stage")
def _(c):
    return c.wf.stages


@query("p9_first_available", 9)
def _(c):
    return c.wf.baseline.select("stay_id", "baseline_mg_dl")


@query("p10_eligible", 9)
def _(c):
    rows = c.fx.icustays.join(c.fx.patients, "subject_id")
    return co.eligible(rows, c.cfg.cohort).select("stay_id", "subject_id", "anchor_age", "los")


@query("p11_diagnosis_match")
def _(c):
    return c.fx.diagnoses_icd.filter(co.diagnosis_match(c.cfg.cohort.excluded_codes))


@query("p12_age_group")
def _(c):
    return c.fx.patients.select("subject_id", F.col("anchor_age").alias("age"),
                                co.age_group("anchor_age").alias("age_group"))


# --- joins ---------------------------------------------------------------------------
@query("j1_attach_static")
def _(c):
    return jn.attach_static(c.fx.icustays, c.fx.patients, c.fx.admissions).select(
        "stay_id", "subject_id", "hadm_id", "gender", "anchor_age", "race", "admittime")


@query("j2_attach_optional", 9)
def _(c):
    stays = c.fx.icustays.select("stay_id", "subject_id")
    return jn.attach_optional(stays, c.wf.weight, "stay_id")


@query("j3_densify", 9)
def _(c):
    grid = gr.hourly_grid(c.fx.icustays, 30, "uo_hour")
    return jn.densify(grid, c.wf.hourly_output, ["stay_id", "uo_hour"], "uo_ml", "has_uo")


@query("j4_lookback_join", 9)
def _(c):
    ep = c.fx.icustays.select("stay_id", "subject_id", "intime")
    ev = c.wf.creatinine.select("subject_id", "charttime", "creatinine_mg_dl")
    return jn.lookback_join(ep, ev, 365)


@query("j5_events_in_episode", 9)
def _(c):
    ep = c.fx.icustays.select("stay_id", "subject_id", "intime")
    ev = c.wf.creatinine.select("subject_id", "charttime", "creatinine_mg_dl")
    return jn.events_in_episode(ep, ev, 30)


@query("j6_asof_join")
def _(c):
    hours_ = gr.hourly_grid(c.fx.icustays).select("stay_id", "t_hour")
    return jn.asof_join(hours_, c.wf.ratio_stages.select("stay_id", "charttime",
                                                         "kdigo_cr_stage"),
                        "stay_id", "t_hour", "charttime", "kdigo_cr_stage", 168)


@query("j7_window_join")
def _(c):
    ev = c.fx.events.select("stay_id", "event_id", F.col("ts").alias("t"))
    return gr.window_join(c.wf.stay_landmarks, ev, (6, 12, 24), "t", c.cfg.landmarks).select(
        "stay_id", "landmark_time", "window_h", "event_id")


@query("j8_landmark_windows")
def _(c):
    """Landmarks crossed with the window list, with the start of each window."""
    lm = gr.explode_column(c.wf.stay_landmarks.select(*LM_KEYS).withColumn(
        "_w", tb.values_column(c.cfg.features.windows)), "_w", "window_h")
    return lm.select(*LM_KEYS, "window_h",
                     (F.col("landmark_time") - F.make_dt_interval(hours=F.col("window_h")))
                     .alias("window_start"))


@query("j9_overlap_flag")
def _(c):
    return gr.overlap_flag(c.wf.stay_landmarks,
                           c.fx.inputevents.select("stay_id", "starttime", "endtime"), 24,
                           cfg=c.cfg.landmarks).drop("landmark_idx")


@query("j10_lookback_closed", 9)
def _(c):
    ev = c.fx.inputevents.select("stay_id", "starttime", "amount")
    lm = c.wf.stay_landmarks
    flags = gr.lookback_flag(lm, ev, 24, "starttime", "given_24h", c.cfg.landmarks)
    sums = gr.lookback_sum(lm, ev, (6, 12, 24), "amount", "starttime", "amount", c.cfg.landmarks)
    return flags.join(sums, ["stay_id", "landmark_idx", "landmark_time"]).drop("landmark_idx")


@query("j11_map_signals")
def _(c):
    rows = jn.map_signals(c.fx.labevents, signal_map(c.spark), "labevents",
                          signal_items("labevents"))
    return rows.select("labevent_id", "itemid", "feature_name", "valid_low", "valid_high")


@query("j12_exclude")
def _(c):
    keys = co.excluded_patients(c.fx.diagnoses_icd, c.cfg.cohort)
    return jn.exclude(c.fx.icustays.select("stay_id", "subject_id"), keys, "subject_id")


@query("j13_exists_in_horizon")
def _(c):
    ev = c.fx.events.filter(F.col("event_type") == "error").select(
        "stay_id", F.col("ts").alias("charttime"))
    return gr.exists_in_horizon(c.wf.stay_landmarks, ev, (24, 48), "charttime", "seen_{}h",
                                c.cfg.landmarks).drop("landmark_idx")


@query("j14_first_match", 9)
def _(c):
    ev = c.fx.events.select("stay_id", "ts", "event_type", "value")
    return jn.first_match(ev, "stay_id", "ts", F.col("value") >= 60, F.col("event_type"),
                          "first_kind")


@query("j15_join_blocks", 9)
def _(c):
    lm = c.wf.stay_landmarks.select("stay_id", "landmark_idx", "landmark_time")
    ev = c.fx.inputevents.select("stay_id", "starttime", "amount")
    sums = gr.lookback_sum(c.wf.stay_landmarks, ev, (24,), "amount", cfg=c.cfg.landmarks)
    seen = gr.lookback_flag(c.wf.stay_landmarks, ev, 6, cfg=c.cfg.landmarks)
    keys = ["stay_id", "landmark_idx"]
    return jn.join_blocks(lm, keys, seen.drop("landmark_time"),
                          sums.drop("landmark_time")).drop("landmark_idx")


# --- grids ------------------------------------------------------------------------------
@query("g1_hourly_grid")
def _(c):
    return gr.hourly_grid(c.fx.icustays, c.cfg.staging.episode_days)


@query("g2_landmarks")
def _(c):
    return c.wf.stay_landmarks.select("stay_id", "subject_id", "intime", "landmark_time")


@query("g3_incident_landmarks")
def _(c):
    lm = c.wf.stay_landmarks.join(c.wf.onset.select("stay_id", "onset_stage1_time"), "stay_id",
                                  "left")
    return gr.drop_after_onset(lm).select("stay_id", "landmark_time", "onset_stage1_time")


@query("g4_hours_since")
def _(c):
    return c.wf.stay_landmarks.select("stay_id", "landmark_time",
                                      gr.hours_since("intime", "landmark_time").alias("hours"))


@query("g5_unnest")
def _(c):
    lists = c.fx.events.select("event_id", F.sequence(F.lit(0), (F.col("event_id") % 4)
                                                      .cast("int")).alias("steps"))
    return gr.explode_column(lists, "steps", "step").drop("steps")


# --- concepts ----------------------------------------------------------------------------
@query("a1_episode_weight", 9)
def _(c):
    return c.wf.weight


@query("a2_baseline", 9)
def _(c):
    return c.wf.baseline


@query("a3_signed_hourly_sum", 6)
def _(c):
    return c.wf.hourly_output


@query("a4_onset")
def _(c):
    return c.wf.onset


@query("c1_rate_stages", 6)
def _(c):
    return c.wf.rate_stages


@query("c1_ratio_stages", 9)
def _(c):
    return c.wf.ratio_stages


@query("w1_first_episode")
def _(c):
    return co.first_episode(c.fx.icustays).select("subject_id", "hadm_id", "stay_id", "intime")


@query("w2_trailing_min", 9)
def _(c):
    ev = c.fx.events.filter(F.col("event_type") == "purchase").select("stay_id", "ts", "value")
    return trailing_min(ev, ev, "stay_id", "ts", "ts", "value",
                        {"min_48h": 48 * HOUR_US, "min_7d": 168 * HOUR_US})


@query("w3_trailing_sums", 6)
def _(c):
    grid = gr.hourly_grid(c.fx.icustays, 30, "uo_hour").drop("subject_id")
    dense = jn.densify(grid, c.wf.hourly_output, ["stay_id", "uo_hour"], "uo_ml", "has_uo")
    return trailing_sums(dense, "stay_id", "uo_hour", {"ml_{}h": "uo_ml", "n_{}h": "has_uo"},
                         (6, 12, 24)).drop("uo_ml", "has_uo")


@query("w5_carry_forward")
def _(c):
    """Last observation carried forward with no age limit."""
    hours_ = gr.hourly_grid(c.fx.icustays).select("stay_id", "t_hour")
    ev = c.fx.events.filter(F.col("event_type") == "view").select("stay_id", "ts", "event_id")
    return jn.asof_join(hours_, ev, "stay_id", "t_hour", "ts", "event_id")


@query("u1_union_events", 9)
def _(c):
    a = c.fx.labevents.select("subject_id", F.lit("lab").alias("source"), "charttime", "valuenum")
    b = c.fx.chartevents.select("subject_id", F.lit("chart").alias("source"), "charttime",
                                "valuenum")
    return jn.union_events(a, b)


@query("u2_distinct_keys")
def _(c):
    return jn.distinct_keys(c.fx.chartevents, "subject_id", "hadm_id", "itemid")


# --- scalar functions -----------------------------------------------------------------------
@query("f1_hour_floor")
def _(c):
    return c.fx.events.select("event_id", hour_floor("ts").alias("t_hour"))


@query("f2_time_arithmetic")
def _(c):
    return c.fx.icustays.select(
        "stay_id", (F.col("intime") + hours(24)).alias("first_landmark"),
        (F.col("outtime") - hours(48)).alias("last_landmark"),
        (micros("outtime") - micros("intime")).alias("length_us"))


@query("f3_hour_boundaries")
def _(c):
    return c.fx.icustays.select("stay_id", hour_boundaries("intime", "outtime").alias("ahead"),
                                hour_boundaries("outtime", "intime").alias("back"))


@query("f4_series")
def _(c):
    return c.fx.icustays.filter("hour(intime) <= hour(outtime)").select(
        "stay_id", F.explode(F.sequence(F.hour("intime"), F.hour("outtime"))).alias("h"))


@query("f5_greatest_least", 9)
def _(c):
    a, b = F.col("baseline_7d"), F.col("baseline_365d")
    return c.wf.baseline.select("stay_id", F.greatest(a, b, F.lit(0.5)).alias("hi"),
                                F.least(a, b, F.lit(0.5)).alias("lo"))


@query("f6_null_handling", 9)
def _(c):
    v = F.col("value") - F.lit(50.0)
    return c.fx.events.select(
        "event_id", F.coalesce(F.when(v > 0, v), F.lit(-1.0)).alias("above"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("kind"),
        safe_ratio(F.col("value"), F.col("event_id") % 3).alias("ratio"),
        F.when(v > 50, "high").when(v > 0, "mid").otherwise("low").alias("level"))


@query("f7_casts")
def _(c):
    return c.fx.events.select(
        "event_id", F.col("event_id").cast("string").alias("id_text"),
        F.concat(F.col("event_type"), F.lit("_"), F.hour("ts").cast("string"), F.lit("h"))
        .alias("tag"), F.col("event_type").try_cast("double").alias("not_a_number"),
        F.col("ts").cast("date").alias("day"))


@query("f8_aggregates", 6)
def _(c):
    """Amounts are added in the order of events, so the side a tie falls on does not depend on
    how rows are dealt over tasks."""
    v, keys = F.col("value"), ["subject_id", "event_type"]
    so_far = Window.partitionBy(*keys).orderBy("event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    total = F.max_by("_sum", "event_id")
    mean = total / F.nullif(F.count(v), F.lit(0))
    return c.fx.events.withColumn("_sum", F.sum(v).over(so_far)).groupBy(*keys).agg(
        F.count("*").alias("n"), total.alias("total"), mean.alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.median(v).alias("mid"), scaled_round(mean, 1).alias("mean_1"))


@query("f9_logit", 9)
def _(c):
    p = F.col("value") / 500.0
    return c.fx.events.select("event_id", raw_logit(p).alias("logit_p"),
                              F.abs(p - 0.5).alias("gap"), F.sqrt(p).alias("root"),
                              F.exp(p).alias("growth"))


@query("f10_bin_index")
def _(c):
    return c.fx.events.select("event_id", bin_index("value", (10.0, 25.0, 50.0)).alias("bin"))


@query("f11_round_half_even")
def _(c):
    doubled = F.floor(F.col("value")) / F.lit(2.0)
    return c.fx.events.select("event_id", F.bround(doubled).cast("int").alias("points"))


@query("f12_range_label")
def _(c):
    lo = F.floor(F.col("value") / 10) * 10 / F.lit(4.0)
    lo = F.when(F.col("value") >= 20, lo)
    hi = F.when(F.col("value") < 90, (F.floor(F.col("value") / 10) * 10 + 10) / F.lit(4.0))
    return c.fx.events.select("event_id", range_label_column(lo, hi).alias("label"))
