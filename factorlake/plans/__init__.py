"""Queries of all operators over the order tables, with the same queries for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("factor_queries", "source_queries", "point_queries", "label_queries", "model_queries", "metric_queries", "portfolio_queries", "basket_queries", "risk_queries", "audit_queries", "stream_queries")


def _registry():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _registry().QUERIES


def oracles() -> dict[str, str]:
    return _registry().ORACLES
