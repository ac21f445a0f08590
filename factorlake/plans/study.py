"""The headline study: sixteen factors, a label and each factor's daily rank IC; and a ridge model on all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.factors import evaluate
from ..functions.recipes import PRICE_RECIPES
from ..operators import labels, linear, metrics, validation
from ..operators.specs import ModelSpec
from ..sources import adapter
from ..sources.shared import cut
from .factor_queries import grid_of

NAMES = [
    "momentum", "volatility", "range", "volume_surge", "liquidity", "illiquidity", "trend_strength", "range_position", "rsi_ratio", "downside_risk", "overnight_momentum", "breakout", "drawdown", "trend_efficiency", "volume_rank", "money_flow",
]


def panel_of(spark: SparkSession, sf_dir: str, window: int = 5) -> DataFrame:
    """Sixteen directed factors and a two-session label for every cell of the grid."""
    made = {n: PRICE_RECIPES[n].build(window) for n in NAMES}
    grid = evaluate(grid_of(spark, sf_dir), made, {n: PRICE_RECIPES[n].direction for n in NAMES})
    return labels.forward_return(grid, 2).select("ts_code", "trade_date", "session_index", *NAMES, "label")


def sixteen_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(factor, mean, std, icir, count): the daily rank ICs of all factors from one pass: rows are unpivoted, so that all
    factors are ranked by one exchange."""
    long = panel_of(spark, sf_dir).unpivot(["ts_code", "trade_date", "label"], NAMES, "factor", "x").withColumn("day", F.struct("factor", "trade_date"))
    daily = metrics.daily_rank_ic(long, "x", "label", by="day")
    std = F.stddev_samp("ic")
    return daily.groupBy(F.col("day.factor").alias("factor")).agg(F.avg("ic").alias("mean"), std.alias("std"), (F.avg("ic") / std).alias("icir"), F.count("ic").alias("count"))


def sixteen_factors_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(refit_date, mse, n): pooled ridge on all factors, refit every thirteen sessions over the last third.

    Samples are summed by the first refit that may train on them; a refit's sums are running sums of these."""
    rows = cut(panel_of(spark, sf_dir))  # summed and then scored: factors aren't made twice
    clipped = rows.withColumns({c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(-3.0)), F.lit(3.0)) for c in NAMES}).withColumn("label", F.least(F.greatest("label", F.lit(-2.0)), F.lit(2.0)))
    sessions = adapter.calendar(rows)
    dated = labels.label_end_date(clipped, sessions, 2)
    schedule = validation.refit_dates(sessions, "1999-08-01", 13)
    refits = sorted(r[0] for r in schedule.select("refit_date").distinct().collect())
    terms = [linear.Term("power", c) for c in NAMES]
    block = reduce(lambda c, k: c.when(F.col("label_end") < F.lit(refits[k]), k), range(len(refits)), F)
    blocks = linear.block_sums(dated.withColumn("__block", block), terms, "label", "__block")
    fits = linear.fit_blocks(blocks, {k: k for k in range(len(refits))}, terms, NAMES, [ModelSpec("ridge", {"alpha": 10.0})])
    served = schedule.join(spark.createDataFrame(list(enumerate(refits)), "fold int, refit_date date"), "refit_date")
    scored = linear.score_terms(dated.join(F.broadcast(served), "trade_date"), fits, terms, ["fold"])
    return scored.filter("label IS NOT NULL AND prediction IS NOT NULL").groupBy("refit_date").agg(F.avg((F.col("prediction") - F.col("label")) ** 2).alias("mse"), F.count("*").alias("n"))
