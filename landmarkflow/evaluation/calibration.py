"""Calibration: reliability table, expected error, logistic slope and intercept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.evaluation.curves import score_table
from landmarkflow.functions.scalars import bin_index, clip, logit
from landmarkflow.sources.tables import materialize, run_folder


def bin_edges(bins: int) -> list:
    """Edges of equal-width bins over [0, 1], as ``i * (1 / bins)``."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def _binned(scores: DataFrame, by, bins: int) -> DataFrame:
    """Counts and score sums per (group, bin), from a score table."""
    idx = F.least(F.greatest(bin_index("p", bin_edges(bins)) - 1, F.lit(0)), F.lit(bins - 1))
    n = F.col("pos") + F.col("neg")
    return scores.groupBy(*by, idx.alias("bin")).agg(
        F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("p") * n).alias("sum_p"))


def ece_of_scores(scores: DataFrame, by=(), bins: int = 10, eps: float = 1e-9) -> DataFrame:
    clipped = scores.withColumn("p", clip("p", eps, 1.0 - eps))
    gap = F.abs(F.col("sum_p") - F.col("pos"))
    b = _binned(clipped, by, bins)
    return b.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ece(df: DataFrame, bins: int = 10, by=(), **cols) -> DataFrame:
    """Mean absolute gap between score and rate over equal-width bins, by bin size."""
    return ece_of_scores(score_table(df, by, **cols), by, bins)


def reliability(df: DataFrame, bins: int = 10, by=(), **cols) -> DataFrame:
    """Mean score and observed rate per bin; empty bins are listed with n = 0."""
    edges = bin_edges(bins)
    rows = _binned(score_table(df, by, **cols), by, bins)
    full = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("bin_left"),
                              F.lit(edges[i + 1]).alias("bin_right")) for i in range(bins)])
    groups = rows.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(full).alias("_b")).select(*by, "_b.*")
    n = F.col("n").cast("double")
    return grid.join(rows, [*by, "bin"], "left").select(
        *by, "bin", "bin_left", "bin_right", F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("sum_p") / n).alias("pred_mean"), (F.col("pos") / n).alias("obs_rate"))


def calibration_of_scores(scores: DataFrame, by=(), c: float = 1e6, max_iter: int = 50,
                          tol: float = 1e-10) -> DataFrame:
    """Slope and intercept of a logistic fit of the outcome on logit(score), per group.

    Newton steps on two parameters: each needs five sums per group over the
    distinct scores, so a step is one aggregation. Parameters are rows of a written
    table, joined by group; only the number of open groups reaches the driver. The
    slope carries the weak penalty ``slope^2 / (2c)``. Groups with one class get NULL.
    """
    by, keys, folder = list(by), [*by, "_one"], run_folder(scores.sparkSession)
    data = scores.select(*by, F.lit(1).alias("_one"), logit("p").alias("_z"), "pos",
                         (F.col("pos") + F.col("neg")).alias("_n")).persist()
    try:
        sides = data.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("_n").alias("_t"))
        state = materialize(starting_state(sides, keys), "calibration_0", folder)
        for step in range(1, max_iter + 1):
            if state.filter("_open").isEmpty():
                break
            state = materialize(_newton_step(data, state, keys, c, tol), f"calibration_{step}",
                                folder)
    finally:
        data.unpersist()
    return state.select(*by, F.col("_b").alias("calibration_slope"),
                        F.col("_a").alias("calibration_intercept"))


def _newton_step(data: DataFrame, state: DataFrame, keys, c: float, tol: float) -> DataFrame:
    """The parameters of the open groups moved by one damped step; the others as they are."""
    rows = data.join(state.filter("_open").select(*keys, "_a", "_b"), keys)
    mu = 1.0 / (1.0 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_z"))))
    res, wt, z = F.col("pos") - F.col("_n") * mu, F.col("_n") * mu * (1.0 - mu), F.col("_z")
    sums = rows.groupBy(*keys).agg(
        F.sum(res).alias("g0"), F.sum(res * z).alias("g1"), F.sum(wt).alias("h00"),
        F.sum(wt * z).alias("h01"), F.sum(wt * z * z).alias("h11"))
    return newton_update(state, sums, keys, c, tol)


def starting_state(sides: DataFrame, keys, a=None, b=None) -> DataFrame:
    """``keys``, ``_a``, ``_b``, ``_open`` from positives ``_p`` and rows ``_t`` per key.

    Keys with one class are closed and have no parameters. Columns ``a`` and ``b`` may
    hold values to start from.
    """
    two = F.coalesce((F.col("_p") > 0) & (F.col("_p") < F.col("_t")), F.lit(False))
    a, b = (F.coalesce(F.col(x), F.lit(0.0)) if x else F.lit(0.0) for x in (a, b))
    return sides.select(*keys, F.when(two, a).alias("_a"), F.when(two, b).alias("_b"),
                        two.alias("_open"))


def newton_update(state: DataFrame, sums: DataFrame, keys, c: float, tol: float) -> DataFrame:
    """The next state, from the gradient and curvature sums of the open keys."""
    g1, h11 = F.col("g1") - F.col("_b") / c, F.col("h11") + 1.0 / c
    det = F.col("h00") * h11 - F.col("h01") * F.col("h01")
    ok = F.coalesce((det > 0) & (det < float("inf")), F.lit(False))
    da = (h11 * F.col("g0") - F.col("h01") * g1) / det
    db = (F.col("h00") * g1 - F.col("h01") * F.col("g0")) / det
    far = F.greatest(F.abs(da), F.abs(db))
    shrink = F.least(F.lit(1.0), 4.0 / F.greatest(far, F.lit(1e-300)))
    moved = F.col("_open") & ok
    return state.join(sums, keys, "left").select(
        *keys, F.when(moved, F.col("_a") + shrink * da).otherwise(F.col("_a")).alias("_a"),
        F.when(moved, F.col("_b") + shrink * db).otherwise(F.col("_b")).alias("_b"),
        (moved & (far >= tol)).alias("_open"))


def calibration_fit(df: DataFrame, by=(), **cols) -> DataFrame:
    return calibration_of_scores(score_table(df, by, **cols), by)
