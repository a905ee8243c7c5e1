"""Look-back statistics per landmark without a range join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import LandmarkConfig
from landmarkflow.functions.timefns import HOUR_US, ceil_div, floor_div, micros
from landmarkflow.operators.grid import grid_starts
from landmarkflow.operators.joins import map_signals, salted_join


def convert_units(events: DataFrame, value: str = "valuenum", name: str = "value") -> DataFrame:
    """``(value + offset) * multiplier``, then keep results in the valid range."""
    out = (F.col(value) + F.col("unit_offset")) * F.col("unit_multiplier")
    return (events.filter(F.col(value).isNotNull()).withColumn(name, out)
            .filter(F.col(name).between(F.col("valid_low"), F.col("valid_high"))))


def numeric_events(chartevents: DataFrame, labevents: DataFrame, stays: DataFrame,
                   signals: DataFrame, items: dict | None = None) -> DataFrame:
    """Vitals and labs as one long relation ``(stay_id, t, feature_name, value)``.

    Labs carry no stay and are placed by admission; ``stays`` holds one stay per
    admission (the cohort). Vitals keep their own stay. ``items`` has the configured
    ids per source, for the scans.
    """
    cols = ("stay_id", F.col("charttime").alias("t"), "feature_name", "value")
    vitals = convert_units(map_signals(
        chartevents.select("stay_id", "charttime", "itemid", "valuenum"), signals, "chartevents",
        items and items["chartevents"]))
    labs = convert_units(map_signals(
        labevents.filter(F.col("hadm_id").isNotNull())
        .select("hadm_id", "charttime", "itemid", "valuenum"), signals, "labevents",
        items and items["labevents"]))
    labs = salted_join(labs.select("hadm_id", "charttime", "feature_name", "value"),
                       stays.select("hadm_id", "stay_id"), "hadm_id")
    return vitals.select(*cols).unionByName(labs.select(*cols))


def fold_signals(events: DataFrame, features, rest: str = "other") -> DataFrame:
    """Events of unlisted features under one name: where only the listed ones get columns,
    the others tell no more than which landmarks have events."""
    name = F.col("feature_name")
    return events.withColumn("feature_name", F.when(name.isin(*features), name).otherwise(rest))


def pane_hours(cfg: LandmarkConfig, windows) -> int:
    """Longest pane that divides the spacing and every window."""
    return reduce(math.gcd, windows, cfg.spacing_hours)


def pane_aggregates(lm: DataFrame, events: DataFrame, windows,
                    cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Statistics of the events in each pane ``(origin + (j-1)g, origin + jg]``.

    All windows are whole numbers of panes, so each event is aggregated once,
    map-side, before anything is repeated per window or landmark.
    """
    g = pane_hours(cfg, windows)
    widest = max(windows) // g
    step = cfg.spacing_hours // g
    placed = salted_join(events.select("stay_id", "feature_name", "t", "value"),
                         grid_starts(lm), "stay_id")
    base = micros("intime") + F.lit(cfg.obs_hours * HOUR_US)
    pane = ceil_div(micros("t") - base, g * HOUR_US)
    placed = (placed.withColumn("pane", pane)
              .filter((F.col("pane") > -widest) & (F.col("pane") <= F.col("last_idx") * step)))
    at = F.struct("t", "value")
    return placed.groupBy("stay_id", "feature_name", "pane").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.max(at).alias("newest"), F.min(at).alias("oldest"))


def rolling_by_window(lm: DataFrame, events: DataFrame, windows=(6, 12, 24),
                      cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """One row per (landmark, feature) with ``{statistic}_{w}h`` columns.

    Each pane is repeated for the landmarks that look back on it, met with the
    landmarks on (stay, index), and combined. The combination of counts, means
    and squared deviations is exact, with no cancellation. Equal event times:
    the larger value is the latest one, the smaller the earliest.
    """
    g = pane_hours(cfg, windows)
    step, widest = cfg.spacing_hours // g, max(windows) // g
    panes = pane_aggregates(lm, events, windows, cfg)
    first = F.greatest(ceil_div(F.col("pane"), step), F.lit(0).cast("bigint"))
    last = floor_div(F.col("pane") + F.lit(widest - 1), step)
    hits = (panes.withColumn("_lo", first).withColumn("_hi", last).filter("_lo <= _hi")
            .withColumn("landmark_idx", F.explode(
                F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))))
            .withColumn("age", F.col("landmark_idx") * step - F.col("pane"))
            .drop("_lo", "_hi", "pane"))
    keys = lm.select("stay_id", "landmark_idx", "landmark_time")
    rows = hits.join(keys, ["stay_id", "landmark_idx"])

    age = F.col("age")
    aggs = []
    for a in range(widest):
        here = age == a
        aggs += [F.max(F.when(here, F.col(c))).alias(f"_{c}{a}") for c in ("n", "mean", "m2")]
    for w in windows:
        held = age < w // g
        aggs += [F.sum(F.when(held, F.col("n"))).alias(f"count_{w}h"),
                 F.min(F.when(held, F.col("lo"))).alias(f"min_{w}h"),
                 F.max(F.when(held, F.col("hi"))).alias(f"max_{w}h"),
                 F.max(F.when(held, F.col("newest"))).alias(f"_new_{w}h"),
                 F.min(F.when(held, F.col("oldest"))).alias(f"_old_{w}h")]
    grouped = rows.groupBy("stay_id", "landmark_idx", "landmark_time", "feature_name").agg(*aggs)

    def total(terms):
        return reduce(lambda x, y: x + y, terms)

    means = {}
    for w in windows:
        count = F.col(f"count_{w}h").cast("double")
        means[f"mean_{w}h"] = total(
            [F.coalesce(F.col(f"_n{a}") * F.col(f"_mean{a}"), F.lit(0.0))
             for a in range(w // g)]) / count
    grouped = grouped.select("*", *[c.alias(n) for n, c in means.items()])
    out = ["stay_id", "landmark_idx", "landmark_time", "feature_name"]
    for w in windows:
        mean, count = F.col(f"mean_{w}h"), F.col(f"count_{w}h")
        ss = total([F.coalesce(F.col(f"_m2{a}") + F.col(f"_n{a}") * F.pow(
            F.col(f"_mean{a}") - mean, F.lit(2.0)), F.lit(0.0)) for a in range(w // g)])
        new, old = F.col(f"_new_{w}h"), F.col(f"_old_{w}h")
        out += [old["t"].alias(f"earliest_time_{w}h"), new["t"].alias(f"latest_time_{w}h"),
                count, mean,
                F.when(count > 1, F.sqrt(ss / (count - 1))).alias(f"std_{w}h"),
                F.col(f"min_{w}h"), F.col(f"max_{w}h"), new["value"].alias(f"latest_{w}h"),
                old["value"].alias(f"earliest_{w}h"),
                (new["value"] - old["value"]).alias(f"delta_{w}h")]
    return grouped.select(*out)


_LONG = (("earliest_event_time", "earliest_time"), ("latest_event_time", "latest_time"),
         ("n_count", "count"), ("mean_val", "mean"), ("std_val", "std"), ("min_val", "min"),
         ("max_val", "max"), ("latest_val", "latest"), ("earliest_val", "earliest"),
         ("delta_val", "delta"))


def rolling_features(lm: DataFrame, events: DataFrame, windows=(6, 12, 24),
                     cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Long form: one row per (landmark, window, feature) with at least one event."""
    wide = rolling_by_window(lm, events, windows, cfg)
    per_window = F.array(*[
        F.struct(F.lit(w).alias("window_h"),
                 *[F.col(f"{src}_{w}h").alias(name) for name, src in _LONG]) for w in windows])
    return (wide.select("stay_id", "landmark_idx", "landmark_time", "feature_name",
                        F.explode(per_window).alias("_w"))
            .select("stay_id", "landmark_idx", "landmark_time", "feature_name", "_w.*")
            .filter(F.col("n_count") > 0))
