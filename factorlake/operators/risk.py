"""Covariances of pools, the volatility of their portfolios, exposures to factors, and the limits that they break."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
#: Symbols of a block: a group has the returns of two blocks.
BLOCK = 32
ACTIVE = 1e-10


def _blocks(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts_code, __place, __blocks): the place of each symbol in its pool, and the pool's number of blocks."""
    names = returns.select(*keys, "ts_code").distinct()
    pool = Window.partitionBy(*keys)
    return names.select(*keys, "ts_code", (F.row_number().over(pool.orderBy("ts_code")) - 1).alias("__place"), F.ceil(F.count("*").over(pool) / BLOCK).cast("int").alias("__blocks"))


def risk_covariance(returns: DataFrame, window: int, shrink: float = 0.1, block: int = BLOCK) -> DataFrame:
    """(basket_id, session_index, a, b, cov): annual sample covariances of all pairs of a pool's symbols over the `window`
    sessions before each session, shrunk to the diagonal. `returns`: (basket_id, ts_code, session_index, r), complete; a
    symbol with a missing return in the window has no covariances there, not even its own.

    The pool is cut into blocks of symbols, and each pair of blocks is a group of its own, whatever the pool's size. In
    a group the sums of products run along the sessions, and a window is the difference of two of them: no row is copied
    into windows. A sample covariance has no negative eigenvalue, nor has its mean with its own diagonal, so there is
    none to cut off but for rounding; portfolio_volatility() takes care of that.
    """
    pools = _blocks(returns, ["basket_id"])
    placed = returns.join(pools, ["basket_id", "ts_code"]).withColumn("__own", F.floor(F.col("__place") / block).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.ceil(F.col("__blocks") * BLOCK / block).cast("int") - 1))
    dealt = placed.withColumn("__other", other).select(
        "basket_id", "session_index", "ts_code", "r", "__own", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j")
    )
    kind = "basket_id string, session_index int, a string, others array<string>, cov array<double>"

    def sums(x: np.ndarray) -> np.ndarray:
        """Sums over the window before each session from the window's length on, the last of them after the last session."""
        run = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return run[window:] - run[:-window]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["__i"].iloc[0]), int(pdf["__j"].iloc[0])
        wide = pdf.pivot(index="session_index", columns="ts_code", values="r")
        first, last = int(wide.index.min()), int(wide.index.max())
        wide = wide.reindex(range(first, last + 1))
        owner = pdf.drop_duplicates("ts_code").set_index("ts_code")["__own"]
        names = [[c for c in wide.columns if owner[c] == k] for k in (i, j)]
        out = []
        if all(names) and len(wide) > window:
            raw = [wide[n].to_numpy(float) for n in names]
            whole = [sums(np.isfinite(x).astype(float)) == window for x in raw]
            held = [np.where(np.isfinite(v), v, 0.0) for v in raw]
            x, y = (np.where(np.isfinite(v), h - h.mean(axis=0), 0.0) for v, h in zip(raw, held, strict=True))  # a shift changes no covariance
            sx, sy = sums(x), sums(y)
            for k, name in enumerate(names[0]):
                cov = (sums(x[:, k : k + 1] * y) - sx[:, k : k + 1] * sy / window) / (window - 1) * YEAR
                factor = np.array([1.0 if name == n else 1 - shrink for n in names[1]])
                known = whole[0][:, k : k + 1] & whole[1]
                for t in range(len(cov) - 1):
                    if known[t].any():
                        out.append((first + window + t, name, np.array(names[1])[known[t]], (cov[t] * factor)[known[t]]))
        made = pd.DataFrame(out, columns=["session_index", "a", "others", "cov"])
        made.insert(0, "basket_id", pdf.basket_id.iloc[0])
        return made

    rows = dealt.groupBy("basket_id", "__i", "__j").applyInPandas(fit, kind)
    cells = rows.select("basket_id", "session_index", "a", F.explode(F.arrays_zip(F.col("others").alias("b"), F.col("cov").alias("v"))).alias("c"))
    cells = cells.select("basket_id", "session_index", "a", F.col("c.b").alias("b"), F.col("c.v").alias("cov"))
    within = pools.select("basket_id", F.col("ts_code").alias("b"), F.floor(F.col("__place") / block).alias("__bb"))
    first_block = pools.select("basket_id", F.col("ts_code").alias("a"), F.floor(F.col("__place") / block).alias("__ab"))
    both = cells.join(within, ["basket_id", "b"]).join(first_block, ["basket_id", "a"])
    sides = F.when(F.col("__ab") == F.col("__bb"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both.select("basket_id", "session_index", F.explode(sides).alias("p"), "cov").select("basket_id", "session_index", "p.a", "p.b", "cov")


def portfolio_volatility(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """(basket_id, session_index, active, unavailable, volatility): the root of w'Cw of each portfolio.

    A portfolio with a held symbol that has no covariances has no volatility; `unavailable` counts these symbols."""
    keys = ["basket_id", "session_index"]
    held = weights.filter(F.abs("weight") > ACTIVE).select(*keys, "ts_code", "weight")
    own = covariance.filter("a = b").select(*keys, F.col("a").alias("ts_code"), F.lit(True).alias("__there"))
    known = held.join(own, [*keys, "ts_code"], "left").groupBy(*keys).agg(F.count("*").alias("active"), F.count_if(F.col("__there").isNull()).alias("unavailable"))
    left = held.select(*keys, F.col("ts_code").alias("a"), F.col("weight").alias("wa"))
    right = held.select(*keys, F.col("ts_code").alias("b"), F.col("weight").alias("wb"))
    terms = covariance.join(left, [*keys, "a"]).join(right, [*keys, "b"]).groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("__v"))
    value = F.when(F.col("unavailable") == 0, F.sqrt(F.greatest("__v", F.lit(0.0))))
    return known.join(terms, keys, "left").select(*keys, "active", "unavailable", value.alias("volatility"))


def factor_scores(grid: DataFrame, factors: list[str]) -> DataFrame:
    """(basket_id, session_index, ts_code, factors): each factor's z-score across the pool, of the session before. Null
    for the whole pool where a symbol lacks the factor or all have one value."""
    pool = Window.partitionBy("basket_id", "session_index")

    def score(c: str) -> Column:
        std = F.stddev_pop(c).over(pool)
        return F.when((F.count(c).over(pool) == F.count("*").over(pool)) & (std >= 1e-12), (F.col(c) - F.avg(c).over(pool)) / std)

    made = grid.select("basket_id", F.col("session_index").cast("int").alias("session_index"), "ts_code", *[score(c).alias(c) for c in factors])
    return made.withColumn("session_index", F.col("session_index") + 1)


def portfolio_exposures(weights: DataFrame, scores: DataFrame, factors: list[str]) -> DataFrame:
    """(basket_id, session_index, factors): weights times scores; null where a held symbol has no score."""
    keys = ["basket_id", "session_index"]
    held = weights.filter(F.abs("weight") > ACTIVE).join(scores, [*keys, "ts_code"], "left")
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col("weight") * F.col(c)))
    return held.groupBy(*keys).agg(*[total(c).alias(c) for c in factors])


def portfolio_risk(weights: DataFrame, net: float, covariance: DataFrame | None = None, target: float | None = None, scores: DataFrame | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """(basket_id, session_index, gross, net, volatility, exposures, issues) of every portfolio of `weights`.

    `issues` names the limits that are broken, in this order: net_exposure_limit; volatility_history_unavailable (a held
    symbol has no covariances) or volatility_target_limit; and for each factor of `limits` factor_exposure_unavailable:
    or factor_exposure_limit: with its name. A portfolio that holds nothing breaks a net limit only.
    """
    keys = ["basket_id", "session_index"]
    day = weights.groupBy(*keys).agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"), F.count_if(F.abs("weight") > ACTIVE).alias("__held"))
    active = F.col("__held") > 0
    issues = [F.when(F.abs("net") > net + ACTIVE, F.lit("net_exposure_limit"))]
    day = day.join(portfolio_volatility(weights, covariance).select(*keys, "volatility"), keys, "left") if covariance is not None else day.withColumn("volatility", F.lit(None).cast("double"))
    if target is not None:
        broken = F.when(F.col("volatility").isNull(), F.lit("volatility_history_unavailable")).when(F.col("volatility") * F.col("volatility") > target**2 + 1e-12, F.lit("volatility_target_limit"))
        issues.append(F.when(active, broken))
    names = list(limits or {})
    if names:
        day = day.join(portfolio_exposures(weights, scores, names), keys, "left")
        for c in names:
            broken = F.when(F.col(c).isNull(), F.lit(f"factor_exposure_unavailable:{c}")).when(F.abs(c) > limits[c] + ACTIVE, F.lit(f"factor_exposure_limit:{c}"))
            issues.append(F.when(active, broken))
    exposures = F.struct(*names).alias("exposures") if names else F.lit(None).cast("struct<none:double>").alias("exposures")
    return day.select(*keys, "gross", "net", "volatility", exposures, F.array_compact(F.array(*issues)).alias("issues"))
