"""Wide feature matrix, encodings and feature families."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmarkflow import config as C
from landmarkflow.config import Config, Family
from landmarkflow.operators.joins import join_blocks
from landmarkflow.operators.rolling import rolling_by_window


def binary_encode(column: str, positive) -> Column:
    return F.coalesce((F.col(column) == positive).cast("int"), F.lit(0))


def group_category(column: str, groups: dict, default: str = "Other") -> Column:
    """Map raw categories to their group; anything unlisted becomes ``default``."""
    pairs = [F.lit(x) for group, raw in groups.items() for value in raw for x in (value, group)]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(default))


def one_hot(column: str, categories, prefix: str = "eth_") -> list:
    """0/1 columns for a fixed category list, so the schema never depends on data."""
    return [(F.col(column) == c).cast("int").alias(f"{prefix}{c}") for c in categories]


def demographics(members: DataFrame, groups: dict | None = None) -> DataFrame:
    groups = groups or C.ETHNICITY_GROUPS
    rows = members.select("stay_id", binary_encode("sex", "M").alias("sex_male"),
                          group_category("ethnicity", groups).alias("_group"))
    return rows.select("stay_id", "sex_male", *one_hot("_group", groups))


def melt_aggs(long: DataFrame, aggs=C.AGGREGATIONS) -> DataFrame:
    """Long statistics to ``(key, agg, val)`` rows."""
    source = {a: ("n_count" if a == "count" else f"{a}_val") for a in aggs}
    keys = ["stay_id", "landmark_time", "window_h", "feature_name"]
    flat = long.select(*keys, *[F.col(source[a]).cast("double").alias(a) for a in aggs])
    return flat.unpivot(keys, list(aggs), "agg", "val")


def pivot_features(by_window: DataFrame, features, windows=(6, 12, 24), aggs=C.AGGREGATIONS
                   ) -> DataFrame:
    """One row per landmark with ``{feature}_{agg}_{w}h`` columns, fixed schema.

    The input has one row per (landmark, feature). Each column is an aggregate of its own,
    so those that are not asked for later are never computed.
    """
    out = []
    for f in features:
        here = F.col("feature_name") == f
        for w in windows:
            for a in aggs:
                col = F.col(f"{a}_{w}h")
                if a == "count":  # an absent window is NULL here, like the other statistics
                    col = F.when(col > 0, col)
                out.append(F.max(F.when(here, col)).alias(f"{f}_{a}_{w}h"))
    return by_window.groupBy("stay_id", "landmark_idx").agg(*out)


def add_missing_flags(df: DataFrame) -> DataFrame:
    """``{f}_missing_{w}h`` = 1 when ``{f}_count_{w}h`` is NULL or 0; one projection."""
    flags = [(F.coalesce(F.col(c), F.lit(0)) == 0).cast("int")
             .alias(c.replace("_count_", "_missing_")) for c in df.columns if "_count_" in c]
    return df.select("*", *flags)


def feature_matrix(lm: DataFrame, members: DataFrame, events: DataFrame, treatments: DataFrame,
                   labels: DataFrame, cfg: Config = Config(), features=None) -> DataFrame:
    """Landmarks with demographics, windowed statistics, treatments and labels.

    All blocks are keyed by (stay, index) and keep that partitioning from the
    rolling step on.
    """
    features = features or C.feature_names()
    wide = pivot_features(rolling_by_window(lm, events, cfg.features.windows, cfg.landmarks),
                          features, cfg.features.windows)
    keys = ["stay_id", "landmark_idx"]
    base = lm.select("landmark_idx", *C.META_COLUMNS).join(
        demographics(members, cfg.ethnicity_groups), "stay_id", "left")
    full = join_blocks(base, keys, labels.drop("subject_id", "landmark_time"), wide,
                       treatments.drop("landmark_time"))
    return add_missing_flags(full.drop("landmark_idx"))


def family_columns(columns, family: Family) -> list:
    """Column list of a family: meta and labels first, then sorted per group."""
    have = set(columns)
    keep = list(C.META_COLUMNS) + list(C.LABEL_COLUMNS)
    if family.encoded_demographics:
        keep += ["sex_male"] + [c for c in columns if c.startswith("eth_")]

    def of(names):
        return sorted(c for c in columns if any(c.startswith(f"{n}_") for n in names))

    if "vitals" in family.include:
        keep += of([v[0] for v in C.VITALS])
    if "labs" in family.include:
        keep += of([lab[0] for lab in C.LABS
                    if not (family.exclude_renal and lab[0] in C.RENAL_LABS)])
    if "treatments" in family.include:
        keep += [c for c in C.TREATMENT_COLUMNS
                 if c in have and not (family.exclude_renal and c in C.RENAL_TREATMENTS)]
    absent = [c for c in family.selected if c not in have]
    if absent:
        warnings.warn(f"feature family asks for missing columns: {absent}", stacklevel=2)
    keep += [c for c in family.selected if c in have]
    return list(dict.fromkeys(c for c in keep if c in have))


def select_family(matrix: DataFrame, family: Family) -> DataFrame:
    return matrix.select(*family_columns(matrix.columns, family))


def feature_columns(columns) -> list:
    """Model inputs: everything but meta columns and labels (age is an input)."""
    return [c for c in columns if c not in C.NOT_FEATURES and not c.startswith("y_")]


def labelled_rows(df: DataFrame, label: str, features=None) -> DataFrame:
    """Rows with a known label, as features plus an integer label."""
    features = features or feature_columns(df.columns)
    keys = [c for c in ("stay_id", "subject_id", "landmark_time", "split") if c in df.columns]
    return df.filter(F.col(label).isNotNull()).select(
        *keys, *features, F.col(label).cast("int").alias(label))


def select_results(results: DataFrame, tasks=None, families=None, models=None) -> DataFrame:
    """Filter result rows by task, family and model; an empty list means all."""
    for column, wanted in (("task", tasks), ("family", families), ("model", models)):
        if wanted:
            results = results.filter(F.col(column).isin(*wanted))
    return results


def minimal_family(matrix: DataFrame, importance: DataFrame, k: int = 10) -> DataFrame:
    """Meta, labels, demographics and the ``k`` leading features of an importance roll-up.

    Names without a column in ``matrix`` take no place. Only the ``k`` names reach
    the driver, as they are column names.
    """
    ranked = importance.orderBy(F.desc("mean_abs_importance"), F.desc("n_artifacts"),
                                "best_rank", "feature")
    ranked = ranked.filter(F.col("feature").isin(*feature_columns(matrix.columns))).limit(k)
    chosen = [r["feature"] for r in ranked.collect()]
    demo = ["age", "sex_male"] + [c for c in matrix.columns if c.startswith("eth_")]
    labels = [c for c in matrix.columns if c.startswith("y_")]
    keep = list(dict.fromkeys([*C.META_COLUMNS, *labels, *demo, *chosen]))
    return matrix.select(*[c for c in keep if c in matrix.columns])
