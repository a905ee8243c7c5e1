"""Choice of representative rows for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landmarkflow.explain.contributions import active_terms, is_active
from landmarkflow.functions.quantiles import exact_quantiles

KEYS = ("stay_id", "subject_id", "landmark_time")
# --- fixed values: terms that decide between cases ----------------------------
PRIORITY = ("creatinine_max_24h", "map_mean_12h", "loop_diuretic_24h")
CONTEXT = ("fluid_input_ml_12h", "glucose_std_24h", "age")
# --- end of fixed values -------------------------------------------------------
TAIL = ("hours_since_icu_admit", *("subject_id", "stay_id", "landmark_time"))


def candidate_pool(scored: DataFrame, y: str = "y") -> DataFrame:
    """Positive rows, or all labelled rows when there is no positive."""
    rows = scored.filter(F.col(y).isNotNull())
    has = rows.agg(F.max((F.col(y) == 1).cast("int"))).scalar()
    return (rows.withColumn("_has", has).filter((F.col("_has") == 0) | (F.col(y) == 1))
            .withColumn("selection_pool", F.when(F.col("_has") == 1, "positive").otherwise("all"))
            .drop("_has"))


def measured_cases(scored: DataFrame, q: float = 0.90, reference: DataFrame | None = None,
                   keys=KEYS) -> DataFrame:
    """Pool rows with their distance to the ``q`` quantile of the pool's scores.

    ``scored`` has ``y, p, n_missing`` and keys; ``reference`` the keys and the
    reference model's ``p_reference``: then the distance counts both models.
    """
    pool = candidate_pool(scored)
    rows = pool.withColumn("target_p", exact_quantiles(pool, [], "p", [q])
                           .select("quantile").scalar())
    d = F.abs(F.col("p") - F.col("target_p"))
    if reference is None:
        return rows.select("*", d.alias("distance_to_target"),
                           F.lit(None).cast("double").alias("agreement_gap"))
    rows = rows.join(reference.select(*keys, "p_reference"), list(keys))
    rows = rows.withColumn("target_p_reference", exact_quantiles(
        rows, [], "p_reference", [q]).select("quantile").scalar())
    d = d + 0.75 * F.abs(F.col("p_reference") - F.col("target_p_reference"))
    return rows.select("*", d.alias("distance_to_target"),
                       F.abs(F.col("p") - F.col("p_reference")).alias("agreement_gap"))


def case_order(columns) -> list:
    tail = [F.col(c) for c in TAIL if c in columns]
    return [F.col("distance_to_target").asc(), F.col("agreement_gap").asc_nulls_last(),
            F.col("n_missing").asc(), F.col("p").desc(), *tail]


def rank_cases(scored: DataFrame, q: float = 0.90, reference: DataFrame | None = None,
               k: int = 10, keys=KEYS) -> DataFrame:
    """The ``k`` pool rows closest to the target (a top-k report), numbered."""
    rows = measured_cases(scored, q, reference, keys)
    best = rows.orderBy(*case_order(rows.columns)).limit(k)
    return _numbered(best, case_order(rows.columns))


def _numbered(top: DataFrame, order) -> DataFrame:
    """Number the rows of a top-k report: a window over k rows."""
    return top.withColumn("case_rank", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(*order)))


def rerank_cases(shortlist: DataFrame, contrib: DataFrame, k: int = 10, keys=KEYS,
                 priority=PRIORITY, context=CONTEXT) -> DataFrame:
    """Reorder a shortlist toward rows whose reference explanation uses central terms.

    If no row does, the order of the shortlist stands.
    """
    keys = list(keys)
    act = is_active()

    def hits(*names):
        return F.count(F.when(act & F.col("feature").isin(*names), 1))

    counts = contrib.groupBy(*keys).agg(
        F.count(F.when(act, 1)).alias("nonzero_terms"), hits(*priority).alias("priority_hits"),
        hits(*context).alias("context_hits"),
        (hits("creatinine_max_24h") > 0).alias("renal_hit"),
        (hits("map_mean_12h") > 0).alias("hemodynamic_hit"))
    terms = active_terms(contrib, keys).drop("n_active")
    rows = shortlist.drop("case_rank").join(counts.join(terms, keys), keys, "left")
    zero = {"nonzero_terms": 0, "priority_hits": 0, "context_hits": 0}
    rows = rows.fillna(zero).fillna({"active_terms": ""}).withColumn(
        "renal_hit", F.coalesce("renal_hit", F.lit(False))).withColumn(
        "hemodynamic_hit", F.coalesce("hemodynamic_hit", F.lit(False)))
    some = F.max("priority_hits").over(Window.partitionBy(F.lit(1))) > 0
    rows = rows.withColumn("_some", some)

    def when_some(c):
        return F.when(F.col("_some"), F.col(c).cast("int")).desc()

    order = [when_some(c) for c in ("priority_hits", "renal_hit", "hemodynamic_hit",
                                    "nonzero_terms", "context_hits")] + case_order(rows.columns)
    best = rows.orderBy(*order).limit(k)
    return _numbered(best, order).withColumn(
        "selection_strategy", F.when(F.col("_some"), "primary_plus_bedside_legibility")
        .otherwise("primary_plus_bedside_agreement")).drop("_some")
