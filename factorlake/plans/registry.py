"""The library's queries and, for each that SQL can express, the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


#: Added before cutting digits off: just over a half, so that values which end in a 5 aren't on the edge.
HALF = 0.5000123


def rounded(x: Column | str, digits: int = 6) -> Column:
    """`x` to so many digits, in the steps of rounded_sql()."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(10.0**digits) + F.lit(HALF)) / F.lit(10.0**digits)


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + {HALF}::DOUBLE) / 1e{digits}::DOUBLE"
