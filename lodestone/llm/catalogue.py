"""Queries and oracle SQL of the subpackage, gathered from its modules."""

from __future__ import annotations

import importlib

MODULES = ["neardup", "topn", "sentences", "chunks", "knn", "packing", "mixing", "pii"]


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
