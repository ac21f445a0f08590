"""Series that all symbols share, joined by date, and series of foreign clocks, joined by what was known before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import Factor, evaluate

STALE_DAYS = 7


def broadcast_by_date(grid: DataFrame, series: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Values of the same date, else null; a series has one row for each date, so it is as small as a calendar."""
    return grid.join(F.broadcast(series.select("trade_date", *[F.col(a).alias(b) for a, b in columns.items()])), "trade_date", "left")


def asof_strict_prior(calendar: DataFrame, series: DataFrame, columns: list[str], stale_days: int = STALE_DAYS) -> DataFrame:
    """For each date the last record before it, not of the same date and not older than `stale_days`; a record
    counts even where its value is null. Both sides are as long as a calendar; one window orders them."""
    record = F.struct(F.col("trade_date").alias("source_date"), *columns)
    both = calendar.select("trade_date", F.lit(None).cast(series.select(record.alias("r")).schema["r"].dataType).alias("r"), F.lit(True).alias("wanted")).unionByName(
        series.select("trade_date", record.alias("r"), F.lit(False).alias("wanted"))
    )
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    before = Window.orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("found", F.max("r").over(before)).filter("wanted")
    fresh = F.datediff("trade_date", "found.source_date") <= stale_days
    return found.select("trade_date", F.when(fresh, F.col("found.source_date")).alias("source_date"), *[F.when(fresh, F.col(f"found.{c}")).alias(c) for c in columns])


def foreign_available_date(series: DataFrame) -> DataFrame:
    """A foreign close is known on the next civil day."""
    return series.withColumn("available_date", F.date_add("trade_date", 1))


def adjusted_close(series: DataFrame) -> DataFrame:
    value = F.col("close") * F.col("adj_factor")
    return series.withColumn("adjusted_close", F.when((value > 0) & (value < float("inf")), value))


def native_clock_factor(calendar: DataFrame, series: DataFrame, factors: dict[str, Factor], stale_days: int = STALE_DAYS) -> DataFrame:
    """Factors on the series' own sessions, then the last ones known before each research date."""
    own = evaluate(series.withColumn("ts_code", F.lit("context")), factors, mask=False)
    return asof_strict_prior(calendar, own, list(factors), stale_days)


def check_global_constant(grid: DataFrame, fields: list[str]) -> DataFrame:
    """Dates on which a field that all symbols share has several values."""
    counted = grid.groupBy("trade_date").agg(*[F.countDistinct(f).alias(f) for f in fields])
    return counted.unpivot(["trade_date"], fields, "field", "n_values").filter("n_values > 1")


def global_restore(grid: DataFrame, field: str) -> DataFrame:
    """A shared field on cells whose own row is missing."""
    days = grid.groupBy("trade_date").agg(F.max(field).alias("__value"))
    return grid.join(F.broadcast(days), "trade_date").withColumn(field, F.coalesce(field, "__value")).drop("__value")
