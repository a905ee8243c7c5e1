"""Ranking and roll-up of term importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ("task", "family", "model")


def rank_terms(importance: DataFrame) -> DataFrame:
    """Rank single-feature terms within each model by |importance|, then name.

    The window holds the terms of one model: a few hundred rows at most.
    """
    single = importance.filter(~F.col("term").contains("&") & ~F.col("term").contains(" x "))
    order = Window.partitionBy(*TRIPLE).orderBy(F.desc("abs_importance"), "feature")
    return (single.select(*TRIPLE, F.col("term").alias("feature"),
                          F.abs("importance").alias("abs_importance"))
            .withColumn("rank", F.row_number().over(order)))


def aggregate_importance(ranked: DataFrame) -> DataFrame:
    """Mean, maximum, number of tasks and best rank per feature."""
    return ranked.groupBy("feature").agg(
        F.avg("abs_importance").alias("mean_abs_importance"),
        F.max("abs_importance").alias("max_abs_importance"),
        F.count_distinct("task").alias("n_artifacts"), F.min("rank").alias("best_rank"))


def selection_table(summary: DataFrame, k: int, source_family: str) -> DataFrame:
    """The roll-up with the ``k`` chosen features marked and numbered.

    One row per feature of a family (hundreds), so one window is fine.
    """
    order = Window.orderBy(F.desc("mean_abs_importance"), F.desc("n_artifacts"), "best_rank",
                           "feature")
    rank = F.row_number().over(order)
    return (summary.withColumn("_r", rank).withColumn("selected", F.col("_r") <= k)
            .withColumn("selected_rank", F.when(F.col("_r") <= k, F.col("_r"))).drop("_r")
            .withColumn("source_family", F.lit(source_family)))
