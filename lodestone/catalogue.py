"""Queries and oracle SQL of the core, gathered from its modules."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "lodestone.operators.flatten",
    "lodestone.operators.retrieval",
    "lodestone.operators.metrics",
    "lodestone.operators.items",
    "lodestone.operators.aggregates",
    "lodestone.operators.dilution",
    "lodestone.operators.benchmark",
    "lodestone.operators.regions",
    "lodestone.operators.relevance",
    "lodestone.operators.subdocs",
    "lodestone.operators.decompose",
    "lodestone.operators.encoders",
    "lodestone.sources.io",
    "lodestone.sources.shards",
    "lodestone.streaming.ingest",
]


def _modules() -> list:
    return [importlib.import_module(m) for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Exact retrieval over the sub-document vectors and the three-level metric report."""
    return queries()["a2_metric_report"](spark, sf)
