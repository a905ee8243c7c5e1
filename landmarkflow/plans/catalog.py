"""All registered queries."""

from __future__ import annotations

import importlib

from landmarkflow.plans.registry import QUERIES

MODULES = ("queries_core", "queries_features", "queries_evaluation", "queries_models")


def all_queries() -> dict:
    for module in MODULES:
        importlib.import_module(f"landmarkflow.plans.{module}")
    return dict(QUERIES)
