"""Binned scorecard design: feature profiles, bins and dummy terms as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.functions.quantiles import exact_quantiles
from landmarkflow.functions.scalars import bin_index, range_label
from landmarkflow.sources.tables import materialize, run_folder

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def long_form(df: DataFrame, features, *keep) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.nanvl(
        F.col(f).cast("double"), F.lit(None)).alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def value_counts(df: DataFrame, features, *by) -> DataFrame:
    """``(by, feature, value, n)``: distinct values and their numbers of rows.

    Profiles and cuts follow from these. They are written once, as each measure would
    otherwise go through all rows again.
    """
    return long_form(df, features, *by).groupBy(*by, "feature", "value").agg(
        F.count("*").alias("n"))


def feature_profiles(df: DataFrame, features, quantiles=QUANTILES) -> DataFrame:
    """Per feature: kind, missing count, mean, population sd, and quantiles.

    ``impute_median`` is 0 for a feature that was never observed.
    """
    counts = materialize(value_counts(df, features), "values", run_folder(df.sparkSession))
    return profiles_of(counts, quantiles)


def profiles_of(rows: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """:func:`feature_profiles` from the :func:`value_counts` of all rows."""
    v = F.col("value")
    binary = F.coalesce(F.max(F.when(v.isNotNull() & ~v.isin(0.0, 1.0), 1)), F.lit(0)) == 0
    base = rows.groupBy("feature").agg(
        F.when(binary, "binary").otherwise("continuous").alias("kind"),
        F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.sum(F.when(v.isNull(), 0).otherwise(F.col("n"))).alias("n_observed"))
    cuts = exact_quantiles(rows, ["feature"], "value", quantiles, "n").groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias(f"q{round(100 * q)}")
        for q in quantiles])
    return base.join(cuts, "feature", "left").withColumn(
        "impute_median", F.coalesce("q50", F.lit(0.0)))


def imputed(df: DataFrame, medians: dict) -> DataFrame:
    """Replace missing values of the named features by their medians, as doubles."""
    return df.select(*[
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(medians[c])))
        .alias(c) if c in medians else F.col(c) for c in df.columns])


def collect_profiles(profiles: DataFrame) -> dict:
    """Profiles by feature name (one small row per model feature)."""
    return {r["feature"]: r.asDict() for r in profiles.collect()}


def check_bins(profiles: dict, edges: dict) -> None:
    for f, p in profiles.items():
        if f in edges and p["kind"] == "binary":
            raise ValueError(f"binary feature {f!r} needs no bin edges")
        if f in edges and not edges[f]:
            raise ValueError(f"bin edges of {f!r} are empty")
        if f not in edges and p["kind"] != "binary":
            raise ValueError(f"continuous feature {f!r} needs bin edges")


def fit_bins(df: DataFrame, features, edges: dict, y: str, profiles: dict | None = None
             ) -> DataFrame:
    """One row per (feature, level) with bounds, reference flag and training counts.

    The reference bin is the one that holds the median; a binary feature has
    the levels 0 and 1, with 0 as reference. Missing values count at the median.
    """
    profiles = profiles or collect_profiles(feature_profiles(df, features))
    check_bins(profiles, edges)
    medians = {f: profiles[f]["impute_median"] for f in features}
    filled = imputed(df.select(*features, F.col(y).cast("int").alias("_y")), medians)
    index = {f: bin_index(f, sorted(set(edges[f]))) if f in edges else F.col(f).cast("int")
             for f in features}
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), index[f].alias("bin_index"))
                      for f in features])
    counts = (filled.select("_y", F.explode(cells).alias("_c"))
              .groupBy("_c.feature", "_c.bin_index")
              .agg(F.count("*").alias("train_n"), F.sum("_y").alias("train_events")))
    levels = df.sparkSession.createDataFrame(
        level_rows(features, edges, medians),
        "feature string, kind string, bin_index int, level_label string, lower_bound double, "
        "upper_bound double, reference boolean, term_name string")
    n = F.coalesce("train_n", F.lit(0))
    return levels.join(counts, ["feature", "bin_index"], "left").select(
        "feature", "kind", "bin_index", "level_label",
        F.col("level_label").alias("range_display"), "lower_bound", "upper_bound", "reference",
        "term_name", n.alias("train_n"), F.coalesce("train_events", F.lit(0)).alias("train_events"),
        (F.col("train_events") / F.col("train_n")).alias("train_event_rate"))


def level_rows(features, edges: dict, medians: dict) -> list:
    """Levels of all features; open ends are NULL."""
    rows = []
    inf = float("inf")
    for f in features:
        if f not in edges:
            rows += [(f, "binary", 0, "0 / absent", None, None, True, None),
                     (f, "binary", 1, "1 / present", None, None, False, f)]
            continue
        cuts = sorted(set(edges[f]))
        bounds = [-inf, *cuts, inf]
        home = sum(medians[f] >= c for c in cuts)
        for i in range(len(cuts) + 1):
            lo, hi = bounds[i], bounds[i + 1]
            ref = i == home
            rows.append((f, "binned_continuous", i, range_label(lo, hi),
                         None if lo == -inf else lo, None if hi == inf else hi, ref,
                         None if ref else f"{f}__bin_{i}"))
    return rows


def transform_bins(df: DataFrame, features, edges: dict, medians: dict) -> DataFrame:
    """Adds one 0/1 column per non-reference bin; binary features pass through."""
    filled = imputed(df, {f: medians[f] for f in features})
    terms = []
    for f, kind, i, *_, ref, term in level_rows(features, edges, medians):
        if kind == "binned_continuous" and not ref:
            terms.append((bin_index(f, sorted(set(edges[f]))) == i).cast("double").alias(term))
    return filled.select("*", *terms)


def term_names(features, edges: dict, medians: dict) -> list:
    return [r[-1] for r in level_rows(features, edges, medians) if r[-1]]
