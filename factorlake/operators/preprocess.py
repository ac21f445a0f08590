"""Statistics of the train rows, applied to any rows. Statistics are one row and are joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import correlation
from .quantiles import Columns, between, neighbours, one_row, quantiles

LEAST = 10


def winsor_bounds(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: <c>_lo and <c>_hi, exact quantiles with linear interpolation; nulls don't count."""
    return quantiles(train, {f"{c}_{end}": (c, p) for c in columns for end, p in (("lo", low), ("hi", high))})


def winsorize(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(bounds))
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"{c}_lo"), f"{c}_hi")) for c in columns}
    return joined.withColumns(clipped).drop(*bounds.columns)


def medians(train: DataFrame, columns: list[str]) -> DataFrame:
    return quantiles(train, {f"{c}_med": (c, 0.5) for c in columns})


def impute(df: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    return df.crossJoin(F.broadcast(values)).withColumns({c: F.coalesce(c, f"{c}_med") for c in columns}).drop(*values.columns)


def moments(train: DataFrame, columns: list[str]) -> DataFrame:
    return train.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def standardize(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    made = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") > 1e-12, F.col(f"{c}_std")).otherwise(1.0) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(made).drop(*stats.columns)


def robust_stats(train: DataFrame, columns: list[str]) -> DataFrame:
    found = quantiles(train, {f"{c}_{q}": (c, p) for c in columns for q, p in (("mid", 0.5), ("q1", 0.25), ("q3", 0.75))})
    return found.select(*[x for c in columns for x in (F.col(f"{c}_mid"), (F.col(f"{c}_q3") - F.col(f"{c}_q1")).alias(f"{c}_iqr"))])


def robust_scale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    made = {c: (F.col(c) - F.col(f"{c}_mid")) / F.when(F.col(f"{c}_iqr") > 1e-12, F.col(f"{c}_iqr")).otherwise(1.0) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(made).drop(*stats.columns)


def global_population(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each date: columns that all symbols share count once a day in a fit."""
    return train.groupBy("trade_date").agg(*[F.max(c).alias(c) for c in columns])


def min_observations(train: DataFrame, columns: list[str], least: int = LEAST) -> DataFrame:
    """Features with fewer than `least` values."""
    return train.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "feature", "n").filter(F.col("n") < least)


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, corr) of all pairs of columns, in one pass over the rows; rows with both values count."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(both(a, b, a)).alias("n"), correlation(both(a, b, a), both(a, b, b)).alias("corr")) for a, b in pairs]).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.*")


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95, least: int = LEAST) -> list[str]:
    """Columns kept, in their order: one is dropped if it correlates at least so much with one kept before."""
    found = {(r["a"], r["b"]): r["corr"] for r in pair_correlations(df, columns).filter(F.col("n") >= least).collect()}
    kept: list[str] = []
    for c in columns:
        if not any(abs(found.get((k, c)) or 0) >= threshold for k in kept):
            kept.append(c)
    return kept


def _fold_parameters(df: DataFrame, columns: list[str], winsor: bool, scale: str) -> dict[str, float | None]:
    """Clipping keeps the order of values and filling puts copies of one value at one place of it, so all quantiles of the
    clipped and filled column are among the raw column's order statistics: one search finds them all."""
    kept = Columns(df, columns)
    try:
        ends = kept.ends()
        rows, shares = ends[""][0], {"lo": 0.01, "hi": 0.99, "med": 0.5}
        wanted, filled = {}, {}
        for c in columns:
            n = ends[c][0]
            if n:
                wanted[c] = {name: neighbours(n, p) for name, p in shares.items()}
                first = wanted[c]["med"][0] + 1  # where the copies of the median stand
                raw = lambda k, n=n, first=first: k if k < first else None if k < first + rows - n else k - (rows - n)
                filled[c] = {name: (raw(a), raw(b), share) for name, (a, b, share) in ((q, neighbours(rows, p)) for q, p in (("q1", 0.25), ("mid", 0.5), ("q3", 0.75)))}
        places = {(c, k) for c in wanted for a, b, _ in [*wanted[c].values(), *(filled[c].values() if scale == "robust" else ())] for k in (a, b) if k is not None}
        values = kept.values(places)
        out: dict[str, float | None] = {}
        for c in columns:
            if c not in wanted:
                names = [*(("lo", "hi") if winsor else ()), "med", *(("mid", "iqr") if scale == "robust" else ())]
                out |= {f"{c}_{name}": None for name in names}
                continue
            lo, hi = (between(values[c, a], values[c, b], s) for a, b, s in (wanted[c]["lo"], wanted[c]["hi"]))
            clipped = lambda k, c=c, lo=lo, hi=hi: min(max(values[c, k], lo), hi) if winsor else values[c, k]
            a, b, s = wanted[c]["med"]
            med = between(clipped(a), clipped(b), s)
            out |= ({f"{c}_lo": lo, f"{c}_hi": hi} if winsor else {}) | {f"{c}_med": med}
            if scale == "robust":
                q = {name: between(*(med if k is None else clipped(k) for k in (a, b)), s) for name, (a, b, s) in filled[c].items()}
                out |= {f"{c}_mid": q["mid"], f"{c}_iqr": q["q3"] - q["q1"]}
        if scale != "robust":
            x = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
            if winsor:
                x = {c: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(out[f"{c}_lo"])), F.lit(out[f"{c}_hi"]))) for c, v in x.items()}
            x = {c: F.coalesce(v, F.lit(out[f"{c}_med"])) for c, v in x.items()}
            out |= kept.rows.agg(*[f for c, v in x.items() for f in (F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"))]).first().asDict()
        return out
    finally:
        kept.release()


def fit_fold_transform(train: DataFrame, columns: list[str], winsor: bool = True, scale: str = "robust", shared: tuple[str, ...] = ()) -> DataFrame:
    """One row of all parameters: bounds, then the clipped columns' medians and scales. Shared columns are fit on
    one value for each date. The train rows are read once, kept for the passes of one search, and released."""
    own, found = [c for c in columns if c not in shared], {}
    if own:
        found |= _fold_parameters(train, own, winsor, scale)
    if shared:
        found |= _fold_parameters(global_population(train, list(shared)), list(shared), winsor, scale)
    return one_row(train, found)


def apply_fold_transform(df: DataFrame, params: DataFrame, columns: list[str], winsor: bool = True, scale: str = "robust") -> DataFrame:
    """Clip, fill, scale."""
    made = {}
    for c in columns:
        x = F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"{c}_lo"), f"{c}_hi")) if winsor else F.col(c)
        x = F.coalesce(x, F.col(f"{c}_med"))
        center, width = (f"{c}_mid", f"{c}_iqr") if scale == "robust" else (f"{c}_mean", f"{c}_std")
        made[c] = (x - F.col(center)) / F.when(F.col(width) > 1e-12, F.col(width)).otherwise(1.0)
    return df.crossJoin(F.broadcast(params)).withColumns(made).drop(*params.columns)
