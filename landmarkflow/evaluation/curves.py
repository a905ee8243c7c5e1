"""ROC and precision-recall measures, exact with ties, in one pass over scores.

Every measure starts from one row per distinct score. Cumulative counts over
the scores are exact without sorting them in one task: scores are put into
cells that are fine near 0 and near 1, whole cells are accumulated on one summary
row each, and scores only inside their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.functions.scalars import share_cell


def score_table(df: DataFrame, by=(), y: str = "y", p: str = "p", weight: str | None = None
                ) -> DataFrame:
    """Positives and negatives per (group, distinct score)."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    hit = F.col(y) == 1
    return (df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
            .groupBy(*by, F.col(p).alias("p"))
            .agg(F.sum(F.when(hit, w).otherwise(0)).alias("pos"),
                 F.sum(F.when(hit, 0).otherwise(w)).alias("neg")))


def cumulative_counts(scores: DataFrame, by=()) -> DataFrame:
    """Adds ``tp``/``fp`` (counts at or above the score) and totals ``n_pos``/``n_neg``."""
    by = list(by)
    s = scores.withColumn("_cell", share_cell("p"))
    cells = s.groupBy(*by, "_cell").agg(F.sum("pos").alias("_cp"), F.sum("neg").alias("_cn"))
    group = Window.partitionBy(*by)  # a row per occupied cell
    above = group.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *by, "_cell", F.coalesce(F.sum("_cp").over(above), F.lit(0)).alias("_pa"),
        F.coalesce(F.sum("_cn").over(above), F.lit(0)).alias("_na"),
        F.sum("_cp").over(group).alias("n_pos"), F.sum("_cn").over(group).alias("n_neg"))
    inside = (Window.partitionBy(*by, "_cell").orderBy(F.desc("p"))
              .rowsBetween(Window.unboundedPreceding, 0))
    s = (s.withColumn("_ip", F.sum("pos").over(inside))
         .withColumn("_in", F.sum("neg").over(inside)))
    return (s.join(cells, [*by, "_cell"])
            .select(*by, "p", "pos", "neg", (F.col("_pa") + F.col("_ip")).alias("tp"),
                    (F.col("_na") + F.col("_in")).alias("fp"), "n_pos", "n_neg"))


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _rate(num: str, den: str) -> Column:
    return _d(num) / F.nullif(_d(den), F.lit(0.0))


def roc(df: DataFrame, by=(), y: str = "y", p: str = "p") -> DataFrame:
    """Curve points at every distinct score, highest first in ``tp``."""
    c = cumulative_counts(score_table(df, by, y, p), by)
    return c.select(*by, F.col("p").alias("threshold"), "tp", "fp",
                    _rate("tp", "n_pos").alias("tpr"), _rate("fp", "n_neg").alias("fpr"))


def metric_columns(level: float = 0.90) -> list:
    """Aggregates over :func:`cumulative_counts` rows of one group.

    AUROC counts tied pairs half. AUPRC is the step sum of precision. The two
    operating points use the full curve with its (0, 0) start.
    """
    tpr, spec = _rate("tp", "n_pos"), F.lit(1.0) - _rate("fp", "n_neg")
    higher = _d("tp") - _d("pos") / 2.0
    pairs = F.nullif(F.max(_d("n_pos")) * F.max(_d("n_neg")), F.lit(0.0))
    n = F.max(F.col("n_pos") + F.col("n_neg"))
    tag = round(level * 100)
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    square = (_d("pos") * F.pow(F.col("p") - 1.0, F.lit(2.0))
              + _d("neg") * F.pow(F.col("p"), F.lit(2.0)))
    return [
        (F.sum(_d("neg") * higher) / pairs).alias("auroc"),
        F.sum(_rate("pos", "n_pos") * _d("tp") / (_d("tp") + _d("fp"))).alias("auprc"),
        (F.max(_d("n_pos")) / n.cast("double")).alias("prevalence"),
        n.alias("n"), F.max("n_pos").alias("n_pos"),
        F.when(both, F.coalesce(F.max(F.when(spec >= level, tpr)), F.lit(0.0)))
        .alias(f"sensitivity_at_spec_{tag}"),
        F.max(F.when(tpr >= level, spec)).alias(f"specificity_at_sens_{tag}"),
        (F.sum(square) / n.cast("double")).alias("brier")]


def discrimination(scores: DataFrame, by=(), level: float = 0.90) -> DataFrame:
    """All ranking measures and the Brier score of each group of a score table."""
    c = cumulative_counts(scores, by)
    return (c.groupBy(*by) if by else c.groupBy()).agg(*metric_columns(level))


def auroc(df: DataFrame, by=(), **cols) -> DataFrame:
    return discrimination(score_table(df, by, **cols), by).select(*by, "auroc")


def auprc(df: DataFrame, by=(), **cols) -> DataFrame:
    return discrimination(score_table(df, by, **cols), by).select(*by, "auprc")


def operating_points(df: DataFrame, level: float = 0.90, by=(), **cols) -> DataFrame:
    tag = round(level * 100)
    return discrimination(score_table(df, by, **cols), by, level).select(
        *by, f"sensitivity_at_spec_{tag}", f"specificity_at_sens_{tag}")


def basic_metrics(df: DataFrame, by=(), y: str = "y", p: str = "p") -> DataFrame:
    err = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("n_pos"),
                               F.avg(y).alias("prevalence"), F.avg(err * err).alias("brier"))
