"""Regular grids per episode, and arithmetic placement of events on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import LandmarkConfig
from landmarkflow.functions.timefns import (
    HOUR_US,
    ceil_div,
    floor_div,
    hour_boundaries,
    hour_floor,
    hours,
    micros,
)
from landmarkflow.operators.joins import salted_join


def hour_span(episodes: DataFrame, max_days: int = 30) -> DataFrame:
    """First and last hour (``_a``, ``_z``) of each episode's hourly grid."""
    start = hour_floor("intime")
    stop = F.least(hour_floor("outtime"), hour_floor(F.col("intime") + hours(24 * max_days)))
    return (episodes.select("stay_id", "subject_id", start.alias("_a"), stop.alias("_z"))
            .filter("_a <= _z"))


def hourly_grid(episodes: DataFrame, max_days: int = 30, name: str = "t_hour") -> DataFrame:
    """Every hour from the hour of ``intime`` to that of ``outtime``, both included.

    Capped at ``max_days``; an open episode runs to the cap.
    """
    return hour_span(episodes, max_days).select(
        "stay_id", "subject_id", F.expr("explode(sequence(_a, _z, INTERVAL 1 HOUR))").alias(name))


def landmarks(episodes: DataFrame, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """One row per prediction time: from ``intime + obs`` every ``spacing`` hours up to
    ``outtime - max_horizon``. All episode columns are kept.

    ``landmark_idx`` is the position on the grid and is never renumbered, so
    later steps can compute which landmarks an event touches.
    """
    stay_us = micros("outtime") - micros("intime")
    room = stay_us - F.lit((cfg.obs_hours + cfg.max_horizon) * HOUR_US)
    last = floor_div(room, cfg.spacing_hours * HOUR_US)
    usable = episodes.filter((stay_us >= cfg.min_stay_hours * HOUR_US) & (room >= 0))
    idx = F.col("landmark_idx")
    return (usable.withColumn("landmark_idx", F.explode(F.sequence(F.lit(0), last.cast("int"))))
            .withColumn("landmark_time", F.col("intime") + F.make_dt_interval(
                hours=F.lit(cfg.obs_hours) + idx * cfg.spacing_hours)))


def drop_after_onset(lm: DataFrame, onset: str = "onset_stage1_time",
                     enabled: bool = True) -> DataFrame:
    """Keep landmarks strictly before the first onset (or all, when disabled)."""
    if not enabled:
        return lm
    return lm.filter(F.col(onset).isNull() | (F.col("landmark_time") < F.col(onset)))


def hours_since(start: str, end: str) -> Column:
    """Elapsed hours, counted as hour marks crossed."""
    return hour_boundaries(start, end)


def grid_starts(lm: DataFrame) -> DataFrame:
    """Per stay: the grid's origin and its last index (one small row per stay)."""
    return lm.groupBy("stay_id").agg(F.min("intime").alias("intime"),
                                     F.max("landmark_idx").alias("last_idx"))


def place_on_grid(events: DataFrame, starts: DataFrame, first_us: Column, last_us: Column,
                  last_closed: bool, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Repeat each event for every landmark ``l`` with ``first_us <= l <= last_us``
    (``<`` when not ``last_closed``), all in epoch microseconds.

    The indexes come from integer arithmetic on the offset from ``intime``, so
    the range condition turns into an equality on (stay, index) and no pair is
    ever compared. Adds ``landmark_idx`` and ``landmark_us``.
    """
    step = cfg.spacing_hours * HOUR_US
    joined = salted_join(events, starts, "stay_id")
    base = micros("intime") + F.lit(cfg.obs_hours * HOUR_US)
    lo = ceil_div(first_us - base, step)
    hi = floor_div(last_us - base, step) if last_closed else ceil_div(last_us - base, step) - 1
    placed = (joined.withColumn("_base", base)
              .withColumn("_lo", F.greatest(lo, F.lit(0).cast("bigint")))
              .withColumn("_hi", F.least(hi, F.col("last_idx").cast("bigint")))
              .filter("_lo <= _hi")
              .withColumn("landmark_idx", F.explode(
                F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int")))))
    return (placed.withColumn("landmark_us", F.col("_base") + F.col("landmark_idx") * F.lit(step))
            .drop("_base", "_lo", "_hi", "intime", "last_idx"))


def window_join(lm: DataFrame, events: DataFrame, windows=(6, 12, 24), time: str = "t",
                cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Rows of ``events`` in ``(landmark - w, landmark]`` for each window length ``w``.

    One expansion serves the widest window; the shorter ones are a filter on age.
    """
    widest = max(windows)
    us = micros(time)
    hits = place_on_grid(events, grid_starts(lm), us, us + F.lit(widest * HOUR_US), False, cfg)
    age = F.col("landmark_us") - us
    held = F.filter(F.array(*[F.lit(w) for w in windows]),
                    lambda w: age < w * F.lit(HOUR_US))
    hits = hits.withColumn("window_h", F.explode(held)).drop("landmark_us")
    return hits.join(lm.select("stay_id", "landmark_idx", "landmark_time"),
                     ["stay_id", "landmark_idx"])


def overlap_flag(lm: DataFrame, intervals: DataFrame, hours_back: int, start: str = "starttime",
                 end: str = "endtime", name: str = "overlap",
                 cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """1 when an interval runs at any time of the look-back: ``start <= l`` and
    ``end > l - hours_back``."""
    hits = place_on_grid(intervals, grid_starts(lm), micros(start),
                         micros(end) + F.lit(hours_back * HOUR_US), False, cfg)
    flags = hits.groupBy("stay_id", "landmark_idx").agg(F.lit(1).alias(name))
    return _onto_landmarks(lm, flags, {name: 0})


def lookback_flag(lm: DataFrame, events: DataFrame, hours_back: int, time: str = "starttime",
                  name: str = "flag", cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """1 when an event lies in the closed range ``[l - hours_back, l]``."""
    us = micros(time)
    hits = place_on_grid(events, grid_starts(lm), us, us + F.lit(hours_back * HOUR_US), True, cfg)
    flags = hits.groupBy("stay_id", "landmark_idx").agg(F.lit(1).alias(name))
    return _onto_landmarks(lm, flags, {name: 0})


def lookback_sum(lm: DataFrame, events: DataFrame, windows, value: str, time: str = "starttime",
                 prefix: str = "sum", cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """Sums of ``value`` over ``[l - w, l]``; NULL where no event falls in."""
    us = micros(time)
    hits = place_on_grid(events, grid_starts(lm), us, us + F.lit(max(windows) * HOUR_US), True,
                         cfg)
    age = F.col("landmark_us") - us
    sums = hits.groupBy("stay_id", "landmark_idx").agg(*[
        F.sum(F.when(age <= w * HOUR_US, F.col(value))).alias(f"{prefix}_{w}h")
        for w in windows])
    return _onto_landmarks(lm, sums, {})


def exists_in_horizon(lm: DataFrame, events: DataFrame, horizons, time: str = "charttime",
                      template: str = "y_{}h", cfg: LandmarkConfig = LandmarkConfig()
                      ) -> DataFrame:
    """Per landmark: is there an event in ``(l, l + h]``, for each horizon ``h``."""
    us = micros(time)
    hits = place_on_grid(events, grid_starts(lm), us - F.lit(max(horizons) * HOUR_US), us, False,
                         cfg)
    ahead = us - F.col("landmark_us")
    flags = hits.groupBy("stay_id", "landmark_idx").agg(*[
        F.max(F.when(ahead <= h * HOUR_US, 1).otherwise(0)).alias(template.format(h))
        for h in horizons])
    return _onto_landmarks(lm, flags, {template.format(h): 0 for h in horizons})


def _onto_landmarks(lm: DataFrame, block: DataFrame, fill: dict) -> DataFrame:
    """Left join of a block onto the landmark key, filling the named columns."""
    names = [c for c in block.columns if c not in ("stay_id", "landmark_idx")]
    keys = lm.select("stay_id", "landmark_idx", "landmark_time")
    return keys.join(block, ["stay_id", "landmark_idx"], "left").select(
        *keys.columns,
        *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
          for c in names])


def explode_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per list element; rows with an empty list vanish."""
    return df.withColumn(name, F.explode(column))
