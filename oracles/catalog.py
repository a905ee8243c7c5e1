"""All oracles."""

from __future__ import annotations

import importlib

MODULES = ("core", "features", "evaluation", "models")


def all_oracles() -> dict:
    out = {}
    for module in MODULES:
        out.update(importlib.import_module(f"oracles.{module}").ORACLES)
    return out
