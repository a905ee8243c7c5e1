"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each group gets a regularised minimum-covariance-determinant estimate: starting
from quartiles, concentration steps keep the share ``support`` of rows that are
nearest by Mahalanobis distance and re-estimate mean and covariance from them.
A step is one aggregation over a small table of statistics; per group it passes
on sums per distance bin, so no group is gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmarkflow.llm.statistics import STATS, text_statistics
from landmarkflow.sources.tables import materialize, run_folder

#: Transformed statistics: logarithms of damped ratios, near to symmetric.
VECTOR = {
    "v_words": "ln(n_words + 5.0)",
    "v_length": "ln((word_chars + 20.0) / (n_words + 5.0))",
    "v_symbols": "ln((n_symbols + 1.0) / (n_words + 20.0))",
    "v_upper": "ln((n_upper + 1.0) / (n_lower + 40.0))",
    "v_lines": "ln((n_dup_lines + 1.0) / (n_lines + 4.0))",
    "v_repeats": "ln((n_repeat_words + 2.0) / (n_words + 20.0))",
    "v_stops": "ln((n_stop + n_mark + 1.0) / (n_words + 10.0))",
    "v_distinct": "ln((n_distinct_words + 5.0) / (n_words + 5.0))",
}
NAMES = tuple(VECTOR)
PAIRS = tuple((i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES)))
BINS_PER_OCTAVE = 16


def chi2_share(x: float, d: int) -> float:
    """Share of the chi-square distribution of ``d`` degrees of freedom up to ``x``."""
    if x <= 0:
        return 0.0
    a = d / 2
    term = total = exp(a * log(x / 2) - x / 2 - lgamma(a + 1))
    k = 1
    while term > 1e-17 * total:
        term *= x / 2 / (a + k)
        total, k = total + term, k + 1
    return min(total, 1.0)


def chi2_quantile(share: float, d: int) -> float:
    low, high = 0.0, 40.0 * d + 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, d) < share else (low, middle)
    return low


@dataclass(frozen=True)
class RobustParams:
    """``floor`` is the standard deviation added to every axis (the regularisation);
    groups under ``min_rows`` rows share the estimate of their language, and
    languages under it that of all rows. A document goes if its squared distance
    is beyond two limits for ``quantile``: that of the chi-square distribution, and
    that of its group, whose logarithms of distances are taken as normal with the
    centre and spread of their quartiles (real texts have longer tails than the first)."""

    support: float = 0.75
    steps: int = 6
    min_rows: int = 200
    floor: float = 0.35
    quantile: float = 0.999
    min_words: int = 10
    repeat_percent: int = 20

    @property
    def cut(self) -> float:
        return chi2_quantile(self.quantile, len(NAMES))

    @property
    def consistency(self) -> float:
        """By this the covariance of the nearest ``support`` of normal rows is too small."""
        if self.support >= 1:
            return 1.0
        d = len(NAMES)
        return self.support / chi2_share(chi2_quantile(self.support, d), d + 2)


def base_failed(params: RobustParams = RobustParams()) -> Column:
    return ((F.col("n_words") < params.min_words)
            | (100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words")))


def _distance() -> Column:
    """Squared Mahalanobis distance from the mean ``m<i>`` by the precision ``p<i>_<j>``."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        term = ((F.col(NAMES[i]) - F.col(f"m{i}")) * (F.col(NAMES[j]) - F.col(f"m{j}"))
                * F.col(f"p{i}_{j}"))
        total = total + (term if i == j else 2.0 * term)
    return F.greatest(total, F.lit(0.0))


PARAM_COLUMNS = ([f"m{i}" for i in range(len(NAMES))] + [f"p{i}_{j}" for i, j in PAIRS])
SUM_COLUMNS = ([f"s{i}" for i in range(len(NAMES))] + [f"q{i}_{j}" for i, j in PAIRS])


def _solve(n: float, sums: np.ndarray, squares: np.ndarray, floor: float,
           consistency: float) -> np.ndarray:
    """Mean and precision (upper triangle) from sums of a support set."""
    d = len(NAMES)
    mean = sums / n
    cov = np.zeros((d, d))
    for (i, j), q in zip(PAIRS, squares):
        cov[i, j] = cov[j, i] = q / n - mean[i] * mean[j]
    precision = np.linalg.inv(consistency * cov + np.eye(d) * floor ** 2)
    return np.concatenate([mean, [precision[i, j] for i, j in PAIRS]])


def _concentrate(support: float, floor: float, consistency: float):
    """Parameters of one group from its bins, nearest first, up to the support size."""
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy(float)
        last = int(np.searchsorted(np.cumsum(n), support * n.sum(), "left")) + 1
        values = bins[SUM_COLUMNS].to_numpy(float)[:last].sum(axis=0)
        d = len(NAMES)
        out = _solve(n[:last].sum(), values[:d], values[d:], floor, consistency)
        return pd.DataFrame([[bins["gid"].iloc[0], *out]], columns=["gid", *PARAM_COLUMNS])
    return run


def groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``gid``: language and source, or the first wider group that is large enough.

    A null language or source is a group of its own.
    """
    lang = F.coalesce("lang", F.lit("\0"))
    fine = F.concat_ws("\1", lang, F.coalesce("source", F.lit("\0")))
    rows = rows.withColumns({"_fine": fine, "_lang": lang})
    per = rows.groupBy("_fine", "_lang").agg(F.count("*").alias("_n"))
    wide = per.groupBy("_lang").agg(F.sum("_n").alias("_m"))
    named = (per.join(wide, "_lang")
             .select("_fine", F.when(F.col("_n") >= min_rows, F.col("_fine"))
                     .when(F.col("_m") >= min_rows, F.col("_lang"))
                     .otherwise(F.lit("")).alias("gid")))
    return rows.join(named, "_fine").drop("_fine", "_lang")


def fit_robust(rows: DataFrame, params: RobustParams = RobustParams(),
               folder: str | None = None) -> DataFrame:
    """One row per ``gid``: ``m<i>`` and ``p<i>_<j>`` of :func:`_distance`.

    ``rows`` (with ``gid`` and :data:`VECTOR`) is read once per step. Each step
    writes its few parameters, so a lost executor never restarts the chain.
    """
    folder = folder or run_folder(rows.sparkSession)
    cuts = rows.groupBy("gid").agg(
        *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"c{i}")
          for i, c in enumerate(NAMES)])
    spread = [(F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349 for i in range(len(NAMES))]
    start = cuts.select("gid", *[F.col(f"c{i}")[1].alias(f"m{i}") for i in range(len(NAMES))], *[
        (F.lit(1.0) / (spread[i] * spread[i] + params.floor ** 2) if i == j
         else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS])
    now = materialize(start, "robust_0", folder)
    schema = "gid string, " + ", ".join(f"{c} double" for c in PARAM_COLUMNS)
    for step in range(1, params.steps + 1):
        placed = rows.join(now, "gid").withColumn(
            "bin", F.floor(BINS_PER_OCTAVE * F.log2(_distance() + F.lit(1e-6))))
        bins = placed.groupBy("gid", "bin").agg(
            F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)],
            *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i, j in PAIRS])
        now = materialize(bins.groupBy("gid").applyInPandas(
            _concentrate(params.support, params.floor, params.consistency), schema), f"robust_{step}", folder)
    return now


def limits(rows: DataFrame, fitted: DataFrame, params: RobustParams = RobustParams()) -> DataFrame:
    """(gid, limit): the largest squared distance that is kept, from the group's own rows."""
    logs = rows.join(fitted, "gid").select("gid", F.ln(_distance() + F.lit(1e-6)).alias("l"))
    cuts = logs.groupBy("gid").agg(F.percentile_approx("l", [0.25, 0.5, 0.75], 1000).alias("c"))
    reach = NormalDist().inv_cdf(params.quantile) / 1.349
    own = F.exp(F.col("c")[1] + F.lit(reach) * (F.col("c")[2] - F.col("c")[0]))
    return cuts.select("gid", F.greatest(own, F.lit(params.cut)).alias("limit"))


def judge(docs: DataFrame, params: RobustParams = RobustParams(),
          folder: str | None = None) -> DataFrame:
    """Per document: statistics, ``base_failed``, ``distance``, ``limit`` and ``kept``.

    Estimates use every document that passes the base limits. Whole texts are
    read once; null and empty texts fail the base limit on words. Columns of
    ``docs`` other than doc_id, text, lang and source are not read.
    """
    folder = folder or run_folder(docs.sparkSession)
    stats = text_statistics(docs, keep=("doc_id", "lang", "source"))
    rows = stats.select("doc_id", "lang", "source", *STATS, base_failed(params).alias("base_failed"),
                        *[F.expr(e).cast("double").alias(c) for c, e in VECTOR.items()])
    rows = materialize(rows, "statistics", folder)
    passed = rows.filter("not base_failed").select("lang", "source", *NAMES)
    sound = materialize(groups(passed, params.min_rows).select("gid", *NAMES), "vectors", folder)
    fitted = fit_robust(sound, params, folder)
    keyed = groups(rows.filter("not base_failed"), params.min_rows)
    fitted = fitted.join(limits(sound, fitted, params), "gid")
    judged = keyed.join(fitted, "gid", "left").withColumn("distance", _distance())
    failed = rows.filter("base_failed").withColumns(
        {c: F.lit(None).cast("double") for c in ("distance", "limit")})
    out = ["doc_id", "lang", "source", *STATS, "base_failed", "distance", "limit"]
    both = judged.select(*out).unionByName(failed.select(*out))
    return both.withColumn("kept", ~F.col("base_failed")
                           & F.coalesce(F.col("distance") <= F.col("limit"), F.lit(True)))
