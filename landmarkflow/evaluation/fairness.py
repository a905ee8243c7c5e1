"""Metric reports per patient subgroup and gap flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.config import EvalConfig
from landmarkflow.evaluation.report import full_report


def subgroup_rows(df: DataFrame, cfg: EvalConfig = EvalConfig(), by=()) -> DataFrame:
    """Each scored row once per attribute it belongs to: sex, age band, ethnicity."""
    band = None
    for lo, hi in cfg.age_bands:
        hit = (F.col("age") >= lo) & (F.col("age") < hi)
        label = F.lit(f"[{lo}, {hi}]")
        band = F.when(hit, label) if band is None else band.when(hit, label)
    sex = F.when(F.col("sex").isin(*cfg.sexes), F.col("sex"))
    eth = F.when(F.col("ethnicity_group").isin(*cfg.ethnicities), F.col("ethnicity_group"))
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("value"))
                      for a, v in (("sex", sex), ("age_group", band), ("ethnicity_group", eth))])
    return (df.select(*by, "y", "p", F.explode(pairs).alias("_s"))
            .select(*by, "y", "p", "_s.*").filter(F.col("value").isNotNull()))


def subgroup_report(df: DataFrame, cfg: EvalConfig = EvalConfig(), by=(),
                    calibration: bool = True) -> DataFrame:
    """Report per (attribute, value); small or one-class subgroups are left out."""
    keys = [*by, "attribute", "value"]
    rows = subgroup_rows(df, cfg, by)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("y").alias("_p"))
    fit = sizes.filter((F.col("_n") >= cfg.min_subgroup_n) & (F.col("_p") > 0)
                       & (F.col("_p") < F.col("_n"))).select(*keys)
    report = full_report(rows.join(fit, keys), keys, cfg.calibration_bins,
                         calibration)
    return flag_disparity(report, cfg.disparity, by)


def flag_disparity(report: DataFrame, threshold: float = 0.05, by=()) -> DataFrame:
    """Mark subgroups further than ``threshold`` from the best of their attribute.

    The windows hold the few values of one attribute.
    """
    attr = Window.partitionBy(*by, "attribute")
    flags = []
    for metric, best in (("auroc", F.max), ("auprc", F.max), ("brier", F.min)):
        gap = F.abs(best(metric).over(attr) - F.col(metric))
        flags.append((gap > threshold).alias(f"{metric}_disparity_flag"))
    return report.select("*", *flags)
