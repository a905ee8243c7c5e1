"""What follows the feature matrix: tuning, training, the minimal family, tests, explanations."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmarkflow.config import FAMILIES, Config, label_column
from landmarkflow.evaluation.results import evaluate_all
from landmarkflow.explain.importance import explain_all, global_importance
from landmarkflow.models.train import MODELS, predict_all, train_all
from landmarkflow.models.tune import search
from landmarkflow.operators.features import family_columns, feature_columns, minimal_family
from landmarkflow.operators.importance import aggregate_importance, rank_terms
from landmarkflow.operators.splits import assign_splits, load_split
from landmarkflow.sources.tables import materialize


@dataclass
class Run:
    """All tables and models of one run; frames are lazy unless they were written."""

    matrices: dict
    fitted: dict
    validation: DataFrame
    predictions: DataFrame
    evaluation: dict
    explanations: dict


def tune_all(matrices: dict, tasks, models=MODELS, cfg: Config = Config(), trials: int = 20
             ) -> dict:
    """Best parameters per (task, family, model), for ``train_all(tuned=...)``."""
    out = {}
    for family, matrix in matrices.items():
        for task in tasks:
            for name in models:
                best = search(load_split(matrix, "train"), feature_columns(matrix.columns),
                              label_column(task), name, trials, cfg.models.folds, cfg.models,
                              cfg.seed).first()
                if best is not None:
                    out[(task, family, name)] = json.loads(best["params"])
    return out


def minimal_matrix(spark, fitted: dict, source: DataFrame, source_family: str, k: int
                   ) -> DataFrame:
    """The ``k`` leading features of the source family's additive models."""
    terms = None
    for (task, family, name), model in sorted(fitted.items()):
        if family == source_family and name == "additive":
            part = global_importance(spark, model).select(
                F.lit(task).alias("task"), F.lit(family).alias("family"),
                F.lit(name).alias("model"), "term", "importance")
            terms = part if terms is None else terms.unionByName(part)
    if terms is None:
        raise ValueError(f"no additive model of {source_family} to rank features by")
    chosen = minimal_family(source, aggregate_importance(rank_terms(terms)), k).columns
    return source.select(*chosen, *[c for c in ("split",) if c not in chosen])


def complete_run(matrix: DataFrame, folder: str, tasks, families, cfg: Config = Config(),
                 models=MODELS, source_family: str = "combined", tuned: dict | None = None,
                 trials: int = 0, iterations: int | None = None) -> Run:
    """From the feature matrix to evaluation and explanation, the minimal family included.

    With ``trials`` parameters are searched first, unless ``tuned`` gives them.
    ``iterations`` overrides the configured bootstrap size.
    """
    spark = matrix.sparkSession
    split = materialize(assign_splits(matrix, cfg.evaluation), "split_matrix", folder)
    matrices = {f: split.select(*family_columns(split.columns, FAMILIES[f]), "split")
                for f in families}
    if trials and tuned is None:
        tuned = tune_all(matrices, tasks, models, cfg, trials)
    fitted, validation = train_all(matrices, tasks, models, cfg.models, tuned=tuned)
    if source_family in matrices and "additive" in models:
        small = minimal_matrix(spark, fitted, matrices[source_family], source_family,
                               FAMILIES["minimal"].max_features)
        matrices["minimal"] = small
        more, table = train_all({"minimal": small}, tasks, models, cfg.models, tuned=tuned)
        fitted, validation = {**fitted, **more}, validation.unionByName(table)
    predictions = materialize(predict_all(fitted, matrices), "predictions", folder)
    return Run(matrices, fitted, validation, predictions,
               evaluate_all(predictions, cfg.evaluation, iterations=iterations),
               explain_all(spark, fitted, matrices))
