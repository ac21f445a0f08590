"""Aggregates that have a value, or null, for any rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of rows that have both values (the caller sees to it that a null in one is a null in the other);
    null if one of them is constant."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.sqrt(spread))
