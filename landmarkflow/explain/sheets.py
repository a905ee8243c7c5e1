"""Printable score sheets as relations over a model's few terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _whole():
    """Window over a whole term table: tens of rows."""
    return Window.partitionBy(F.lit(1))


def _points(value, counted):
    """Integer points: value over the smallest non-zero |value|, half to even."""
    smallest = F.min(F.when(counted & (value != 0), F.abs(value))).over(_whole())
    return F.bround(value / F.coalesce(smallest, F.lit(1.0))).cast("int")


def linear_sheet(terms: DataFrame, selected_c: float | None = None) -> DataFrame:
    """Odds ratios per SD and per unit, anchors, and integer points per SD."""
    coef = F.col("coefficient")
    unit = coef / F.col("scale")
    return terms.select(
        "feature", "kind", coef.alias("coefficient_per_sd"),
        F.exp(coef).alias("odds_ratio_per_sd"), unit.alias("logodds_per_unit"),
        F.exp(unit).alias("odds_ratio_per_unit"), "impute_median",
        F.col("mean").alias("train_mean"), F.col("scale").alias("train_sd"), "q10", "q25",
        F.col("q50").alias("median"), "q75", "q90",
        F.lit(selected_c).cast("double").alias("selected_C"),
        _points(coef, F.lit(True)).alias("points_per_sd"))


def linear_points(terms: DataFrame) -> DataFrame:
    """Points at the anchor values of each feature, relative to its median.

    Anchors that round to the same value are listed once, under the first name.
    """
    quant = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("anchor"), F.col(q).alias("v"))
                      for i, (n, q) in enumerate((("Q25", "q25"), ("Median", "q50"),
                                                  ("Q75", "q75"), ("Q90", "q90")))])
    flags = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("anchor"), F.lit(v).alias("v"))
                      for i, (n, v) in enumerate((("0 / absent", 0.0), ("1 / present", 1.0)))])
    rows = terms.select("*", F.explode(F.when(F.col("kind") == "binary", flags)
                                       .otherwise(quant)).alias("_a")).select("*", "_a.*")
    same = Window.partitionBy("feature", F.round("v", 8)).orderBy("i")
    rows = rows.filter(F.col("v").isNotNull()).withColumn("_n", F.row_number().over(same)).filter(
        "_n = 1")
    base = F.coalesce("q50", "impute_median")
    delta = F.col("coefficient") * ((F.col("v") - F.col("mean")) / F.col("scale")
                                    - (base - F.col("mean")) / F.col("scale"))
    rows = rows.select("feature", "kind", "anchor", F.col("v").alias("representative_value"),
                       base.alias("baseline_value"), delta.alias("delta_logodds_vs_median"))
    return rows.withColumn("points_vs_median",
                           _points(F.col("delta_logodds_vs_median"), F.lit(True)))


def binned_sheet(levels: DataFrame) -> DataFrame:
    """Coefficient, odds ratio, counts and points per level, and the sheet position.

    Features with the largest points come first, in each the reference level,
    then falling points.
    """
    coef = F.col("coefficient")
    points = F.when(F.col("reference"), 0).otherwise(_points(coef, ~F.col("reference")))
    rows = levels.select(
        "feature", "kind", "level_label", "range_display", "lower_bound", "upper_bound",
        "reference", coef.alias("coefficient_logodds_vs_reference"),
        F.exp(coef).alias("odds_ratio_vs_reference"), "train_n", "train_events",
        "train_event_rate", points.alias("points_vs_reference"))
    top = F.max(F.abs("points_vs_reference")).over(Window.partitionBy("feature"))
    order = _whole().orderBy(F.desc("_top"), "feature", F.desc("reference"),
                          F.desc("points_vs_reference"), "level_label")
    return (rows.withColumn("_top", top).withColumn("sheet_position", F.row_number().over(order))
            .drop("_top"))


def sheet_summary(sheet: DataFrame, selected_c: float | None = None) -> DataFrame:
    """One row per feature of a binned sheet."""
    return sheet.groupBy("feature", "kind").agg(
        F.count("*").alias("n_levels"),
        F.max(F.when(F.col("reference"), F.col("level_label"))).alias("reference_level"),
        F.max(F.abs("coefficient_logodds_vs_reference")).alias("max_abs_logodds"),
        F.max(F.abs("points_vs_reference")).alias("max_abs_points"),
        F.min("train_n").alias("min_train_n"), F.max("train_n").alias("max_train_n"),
        F.max("train_event_rate").alias("max_train_event_rate"),
        F.lit(selected_c).cast("double").alias("selected_C"))
