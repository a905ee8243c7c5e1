"""Decision curves: net benefit over a list of thresholds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.evaluation.curves import score_table
from landmarkflow.functions.scalars import bin_index


def thresholds(lo: float = 0.01, hi: float = 0.50, step: float = 0.01) -> list:
    return [lo + i * step for i in range(math.ceil((hi + 1e-9 - lo) / step))]


def decision_curve(df: DataFrame, grid=None, by=(), **cols) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none.

    A score adds to every threshold at or below it. Scores are first counted
    per threshold interval, so each row is read once whatever the grid length.
    """
    by = list(by)
    grid = grid or thresholds()
    slots = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(t).alias("threshold"))
                      for i, t in enumerate(grid)])
    parts = (score_table(df, by, **cols).groupBy(*by, bin_index("p", grid).alias("_k"))
             .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    totals = parts.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    above = (parts.filter("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), "_k")))
             .groupBy(*by, "_i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp")))
    rows = (totals.select(*by, "_P", "_N", F.explode(slots).alias("_s"))
            .select(*by, "_P", "_N", "_s.*").join(above, [*by, "_i"], "left"))
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    n = (F.col("_P") + F.col("_N"))
    odds = F.col("threshold") / (1.0 - F.col("threshold"))
    prev = F.col("_P") / n.cast("double")
    return rows.select(
        *by, "threshold", (tp / n - fp / n * odds).alias("nb_model"),
        (prev - (1.0 - prev) * odds).alias("nb_all"), F.lit(0.0).alias("nb_none"),
        tp.alias("tp"), fp.alias("fp"), n.alias("n"))


def net_benefit_at(df: DataFrame, threshold: float, by=(), **cols) -> DataFrame:
    return decision_curve(df, [threshold], by, **cols).select(*by, "threshold", "nb_model")


def nearest_net_benefit(curve: DataFrame, wanted, by=()) -> DataFrame:
    """Saved net benefit closest to each wanted threshold (ties: the lower one)."""
    asked = curve.withColumn("wanted", F.explode(F.array(*[F.lit(float(t)) for t in wanted])))
    near = F.struct(F.abs(F.col("threshold") - F.col("wanted")), F.col("threshold"))
    return asked.groupBy(*by, "wanted").agg(F.min_by("nb_model", near).alias("nb_model"))
