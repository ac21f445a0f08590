"""Economic transforms of a symbol's column: causal and without fitted parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .factors import finite, sessions

TRAILING = 20


def transform(x: Column, kind: str, lag: int = 1, unit: float = 1.0) -> Column:
    """The transform `kind` of a column; those that look back need the complete session grid."""
    before = F.lag(x, lag).over(sessions())
    change = F.when((x > 0) & (before > 0), x / before)
    trailing = sessions().rowsBetween(-TRAILING, -1)
    made = {
        "identity": lambda: x,
        "log_positive": lambda: F.when(x > 0, F.log(x)),
        "log1p_nonnegative": lambda: F.when(x >= 0, F.log1p(x)),
        "reciprocal_nonzero": lambda: F.when(x != 0, 1 / x),
        "percent_to_fraction": lambda: x / 100,
        "signed_log1p": lambda: F.signum(x) * F.log1p(F.abs(x) / unit),
        "first_difference": lambda: x - before,
        "simple_return": lambda: change - 1,
        "log_return": lambda: F.log(change),
        "return_over_trailing_volatility": lambda: F.when((F.count(x).over(trailing) == TRAILING) & (F.stddev_samp(x).over(trailing) > 1e-8), x / F.stddev_samp(x).over(trailing)),
    }
    return finite(made[kind]())


# The transform of each type of field.
DEFAULTS = {
    "price": "simple_return",
    "log_price": "first_difference",
    "size": "log_positive",
    "flow": "log1p_nonnegative",
    "multiple": "reciprocal_nonzero",
    "percent": "percent_to_fraction",
    "currency": "signed_log1p",
    "ratio": "identity",
}


def default_transform(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Each field by the transform of its type, as <field>_t."""
    return df.withColumns({f"{f}_t": transform(F.col(f), DEFAULTS[t]) for f, t in types.items()})


def apply_transform(df: DataFrame, column: str, kind: str, lag: int = 1, unit: float = 1.0) -> DataFrame:
    if kind == "return_over_trailing_volatility":  # the return of the session before is in its own window
        df = df.withColumn("__r", transform(F.col(column), "simple_return", lag))
        return df.withColumn("value", transform(F.col("__r"), kind)).drop("__r")
    return df.withColumn("value", transform(F.col(column), kind, lag, unit))
