"""Portfolio tables: weights, costs, returns and exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def by(key: str = "ts_code") -> Window:
    return Window.partitionBy(key).orderBy("trade_date")


def top_n_weights(scores: DataFrame, n: int, most: float, every: int = 1) -> DataFrame:
    """On each rebalance session with at least n scores the n best, equally weighed; ties by symbol."""
    rows = scores.filter(F.col("score").isNotNull() & (F.col("session_index") % every == 0))
    day = Window.partitionBy("trade_date")
    placed = rows.withColumns({"place": F.row_number().over(day.orderBy(F.desc("score"), "ts_code")), "__n": F.count("*").over(day)})
    return placed.filter((F.col("place") <= n) & (F.col("__n") >= n)).select("trade_date", "ts_code", "place", F.least(F.lit(1.0 / n), F.lit(most)).alias("weight"))


def trade_cost(notional: Column, sell: Column, commission_bps: float, least: float, slippage_bps: float, tax_bps: float, transfer_bps: float) -> Column:
    """Commission (with a least amount), slippage, tax of sales and transfer fee; nothing for no trade."""
    parts = F.greatest(notional * commission_bps / 1e4, F.lit(least)) + notional * slippage_bps / 1e4 + F.when(sell, notional * tax_bps / 1e4).otherwise(0.0) + notional * transfer_bps / 1e4
    return F.when(notional > 1e-10, parts).otherwise(0.0)


def weights_to_returns(grid: DataFrame, weights: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """(trade_date, gross_return, turnover, net_return): weights of a session are held from the next open to the one
    after; changes of weights cost. A weight without a return earns nothing."""
    w = by()
    moved = grid.select("ts_code", "trade_date", (F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1).alias("r"))
    held = moved.join(weights.select("ts_code", "trade_date", "weight"), ["ts_code", "trade_date"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    changed = held.withColumn("turn", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    daily = changed.groupBy("trade_date").agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("gross_return"), F.sum("turn").alias("turnover"))
    return daily.withColumn("net_return", F.col("gross_return") - F.col("turnover") * cost_bps / 1e4)


def equity_metrics(daily: DataFrame, column: str = "net_return") -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, deepest fall and turnover of a series of daily returns."""
    path = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    nav = daily.withColumn("nav", F.exp(F.sum(F.log1p(column)).over(path)))
    fall = nav.withColumn("fall", F.col("nav") / F.greatest(F.max("nav").over(path), F.lit(1.0)) - 1)
    std = F.stddev_samp(column)
    total = F.exp(F.sum(F.log1p(column)))
    return fall.agg(
        (total - 1).alias("total_return"), (F.pow(total, YEAR / F.count(column)) - 1).alias("annual_return"), (std * YEAR**0.5).alias("volatility"), F.when(std > 1e-12, F.avg(column) / std * YEAR**0.5).alias("sharpe"), F.min("fall").alias("max_drawdown"), F.sum("turnover").alias("turnover")
    )


def borrow_cost(short_value: Column, bps: float) -> Column:
    return F.greatest(-short_value, F.lit(0.0)) * bps / 1e4 / YEAR


def factor_exposure(grid: DataFrame, weights: DataFrame, factor: str) -> DataFrame:
    """Weights times the cross-section z-score of the session before. A session on which some symbol lacks the factor,
    or all have one value, gives no exposure: it is null."""
    day = Window.partitionBy("trade_date")
    std = F.stddev_pop(factor).over(day)
    whole = (F.count(factor).over(day) == F.count("*").over(day)) & (std > 1e-12)
    z = grid.withColumn("__z", F.when(whole, (F.col(factor) - F.avg(factor).over(day)) / std))
    lagged = z.select("ts_code", "trade_date", F.lag("__z").over(by()).alias("z"))
    return weights.join(lagged, ["ts_code", "trade_date"]).groupBy("trade_date").agg(F.when(F.count("z") == F.count("*"), F.sum(F.col("weight") * F.col("z"))).alias("exposure"), F.count("z").alias("n"))


def risk_breaches(weights: DataFrame, gross: float, net: float, single: float) -> DataFrame:
    """Dates on which a limit is broken, with the measures; operators/risk.py has limits of volatility and exposures."""
    day = weights.groupBy("trade_date").agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"), F.max(F.abs("weight")).alias("largest"))
    flags = {"gross_breach": F.col("gross") > gross, "net_breach": F.abs("net") > net, "single_breach": F.col("largest") > single}
    return day.withColumns(flags).filter(" OR ".join(flags))


def buy_and_hold_benchmark(grid: DataFrame, capital: float = 1.0) -> DataFrame:
    """Equal capital in each symbol that trades on the first session, bought at its close there and held at its last seen
    close; the share of a symbol without a close or volume on that session stays cash."""
    first = grid.agg(F.min("trade_date").alias("__first"))
    rows = mark_last_close(grid).crossJoin(F.broadcast(first))
    n = F.count("*").over(Window.partitionBy("trade_date"))
    start = F.max(F.when((F.col("trade_date") == F.col("__first")) & (F.col("vol") > 0), F.col("close"))).over(Window.partitionBy("ts_code"))
    own = rows.withColumns({"__n": n, "__start": start})
    value = capital / F.col("__n") * F.coalesce(F.col("mark") / F.col("__start"), F.lit(1.0))
    return own.groupBy("trade_date").agg(F.sum(value).alias("benchmark"))


def mark_last_close(grid: DataFrame) -> DataFrame:
    """The last observed close, and whether it is an old one."""
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumns({"mark": F.last("close", ignorenulls=True).over(upto), "stale": F.col("close").isNull() & F.last("close", ignorenulls=True).over(upto).isNotNull()})


def exposure_series(positions: DataFrame) -> DataFrame:
    """From (trade_date, value, nav): gross, net, long and short value over net worth."""
    nav = F.max("nav")
    pos, neg = F.sum(F.greatest("value", F.lit(0.0))), F.sum(F.least("value", F.lit(0.0)))
    return positions.groupBy("trade_date").agg((F.sum(F.abs("value")) / nav).alias("gross"), (F.sum("value") / nav).alias("net"), (pos / nav).alias("long"), (neg / nav).alias("short"))


def tradable_flag(grid: DataFrame) -> DataFrame:
    """A finite open and volume; a bar of one price away from the last close can't be traded in that direction."""
    before = F.lag("close").over(by())
    open_ = (F.col("open") > 0) & (F.col("vol") > 0)
    one_price = (F.col("high") == F.col("low")) & before.isNotNull()
    return grid.withColumns({
        "can_buy": F.coalesce(open_ & ~F.coalesce(one_price & (F.col("open") > before), F.lit(False)), F.lit(False)), "can_sell": F.coalesce(open_ & ~F.coalesce(one_price & (F.col("open") < before), F.lit(False)), F.lit(False)),
    })
