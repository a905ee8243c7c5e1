"""Prevalence per split and feature drift against the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_prevalence(df: DataFrame, labels=None) -> DataFrame:
    labels = labels or [c for c in df.columns if c.startswith("y_")]
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("stay_id").alias("n_stays"),
        F.count_distinct("subject_id").alias("n_patients"),
        *[F.avg(c).alias(f"prev.{c}") for c in labels])


def feature_drift(df: DataFrame, features, threshold: float = 0.1) -> DataFrame:
    """Standardised mean difference of every feature and split against ``train``.

    One pass turns each row into (feature, value) pairs and combines them
    map-side into a handful of numbers per (split, feature); NaN counts as
    missing. Features empty in train, or in the split, give no row.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"),
                               F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("value"))
                      for f in features])
    stats = (df.select("split", F.explode(pairs).alias("_p"))
             .groupBy("split", "_p.feature")
             .agg(F.count("*").alias("rows"), F.count("_p.value").alias("n"),
                  F.avg("_p.value").alias("mean"), F.var_samp("_p.value").alias("var")))

    def side(name, suffix):
        return [F.col("n").alias(f"n_{name}"), F.col("mean").alias(f"mean_{name}"),
                F.col("var").alias(f"_var_{suffix}"),
                (1.0 - F.col("n") / F.col("rows")).alias(f"missing_rate_{name}")]

    known = stats.filter(F.col("n") > 0)
    train = known.filter(F.col("split") == "train").select("feature", *side("train", "t"))
    other = known.filter(F.col("split").isin("val", "test")).select("feature", "split",
                                                                    *side("split", "s"))
    pooled = F.sqrt((F.col("_var_t") + F.col("_var_s")) / 2.0)
    smd = F.when(pooled > 0, (F.col("mean_split") - F.col("mean_train")) / pooled).otherwise(0.0)
    out = other.join(train, "feature").withColumn("smd", smd)
    return out.select("feature", "split", "n_train", "n_split", "mean_train", "mean_split", "smd",
                      F.abs("smd").alias("abs_smd"), "missing_rate_train", "missing_rate_split",
                      (F.abs("smd") > threshold).alias("flagged"))
