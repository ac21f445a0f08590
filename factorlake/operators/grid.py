"""The complete session grid: every session of the calendar for every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_grid(bars: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """calendar x symbols with observed rows joined on; missing sessions are null.

    The product is what is asked for: its rows are sessions times symbols, and only the calendar, which is as
    long as the years studied, is small.
    """
    cells = symbols.crossJoin(F.broadcast(calendar))
    return cells.join(bars, ["ts_code", "trade_date"], "left")


def coverage(grid: DataFrame) -> DataFrame:
    """Observed, expected and missing rows of each symbol."""
    seen = F.count("close")
    return grid.groupBy("ts_code").agg(seen.alias("observed_rows"), F.count("*").alias("expected_rows"), (F.count("*") - seen).alias("missing_rows"))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows in which each field is present."""
    shares = df.agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields])
    return shares.unpivot([], fields, "field", "coverage")
