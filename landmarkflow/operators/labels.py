"""Forward-horizon outcomes per landmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import LandmarkConfig
from landmarkflow.functions.timefns import hours
from landmarkflow.operators.grid import exists_in_horizon


def horizon_labels(lm: DataFrame, stages=(1, 2), horizons=(24, 48)) -> DataFrame:
    """1 when the onset lies in ``(landmark, landmark + h]``, else 0."""
    at = F.col("landmark_time")
    cols = []
    for s in stages:
        t = F.col(f"onset_stage{s}_time")
        for h in horizons:
            hit = t.isNotNull() & (t > at) & (t <= at + hours(h))
            cols.append(F.when(hit, 1).otherwise(0).alias(f"y_stage{s}_{h}h"))
    return lm.select("stay_id", "subject_id", "landmark_idx", "landmark_time", *cols)


def event_labels(lm: DataFrame, staged: DataFrame, horizons=(24, 48),
                 cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    """1 when any measurement of stage 1 or more lies in the horizon (not only the first)."""
    return exists_in_horizon(lm, staged.filter(F.col("kdigo_cr_stage") >= 1)
                             .select("stay_id", "charttime"), horizons, "charttime",
                             "y_cr_only_stage1_{}h", cfg)


def labels(lm: DataFrame, staged: DataFrame, cfg: LandmarkConfig = LandmarkConfig()) -> DataFrame:
    main = horizon_labels(lm, horizons=cfg.horizons)
    extra = event_labels(lm, staged, cfg.horizons, cfg).drop("landmark_time")
    return main.join(extra, ["stay_id", "landmark_idx"])
