"""All registered queries."""
from __future__ import annotations

import importlib

MODULES = ("cells", "rollups", "relational", "folds", "weights", "selection", "evidence", "similarity", "probs",
           "metrics", "audits", "fits")


def _load():
    for name in MODULES:
        try:
            importlib.import_module(f"glyphmill.catalog.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"glyphmill.catalog.{name}":
                raise
    from glyphmill.catalog import base

    return base


def all_queries():
    return _load().QUERIES


def all_oracles():
    return _load().ORACLES
