"""Diagnostics of factors and forecasts: information coefficients, distributions, losses, bootstrap intervals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation
from ..sources.shared import mean_ranks
from .quantiles import quantiles

TINY = 1e-12


def average_rank(x: str, by: list[str]) -> Column:
    """Rank within a group, ties getting the mean of their places."""
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def both_present(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def daily_rank_ic(df: DataFrame, factor: str, label: str, min_rows: int = 3, by: str = "trade_date") -> DataFrame:
    """(date, ic, n): Spearman correlation of each day with enough rows on which both columns vary."""
    rows = both_present(df, factor, label).select(by, factor, label)
    ranked = rows.withColumns({"__a": average_rank(factor, [by]), "__b": average_rank(label, [by])})
    made = ranked.groupBy(by).agg(F.count("*").alias("n"), correlation("__a", "__b").alias("ic"), F.min(factor).alias("a0"), F.max(factor).alias("a1"), F.min(label).alias("b0"), F.max(label).alias("b1"))
    return made.filter((F.col("n") >= min_rows) & (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))).select(by, "ic", "n")


def daily_pearson_ic(df: DataFrame, factor: str, label: str, min_rows: int = 3, by: str = "trade_date") -> DataFrame:
    made = both_present(df, factor, label).groupBy(by).agg(F.count("*").alias("n"), correlation(factor, label).alias("ic"), F.stddev_pop(factor).alias("s"), F.stddev_pop(label).alias("t"))
    return made.filter((F.col("n") >= min_rows) & (F.col("s") > TINY) & (F.col("t") > TINY)).select(by, "ic", "n")


def ic_summary(daily: DataFrame, ic: str = "ic") -> DataFrame:
    std = F.stddev_samp(ic)
    return daily.agg(F.avg(ic).alias("mean"), std.alias("std"), F.when(std > TINY, F.avg(ic) / std).alias("icir"), F.count(ic).alias("count"))


def quantile_returns(df: DataFrame, factor: str, label: str, groups: int = 5) -> DataFrame:
    """(date, bucket, mean, n): each day's rows in order of the factor, then the symbol, cut into equal buckets."""
    rows = both_present(df, factor, label).select("trade_date", "ts_code", factor, label)
    day = Window.partitionBy("trade_date")
    placed = rows.withColumns({"__i": F.row_number().over(day.orderBy(factor, "ts_code")) - 1, "__n": F.count("*").over(day), "__lo": F.min(factor).over(day), "__hi": F.max(factor).over(day)})
    used = placed.filter((F.col("__n") >= groups) & (F.col("__lo") < F.col("__hi")))
    return used.withColumn("bucket", F.floor(F.col("__i") * groups / F.col("__n"))).groupBy("trade_date", "bucket").agg(F.avg(label).alias("mean"), F.count("*").alias("n"))


def long_short(buckets: DataFrame, groups: int = 5) -> DataFrame:
    pick = lambda b: F.max(F.when(F.col("bucket") == b, F.col("mean")))
    return buckets.groupBy("trade_date").agg((pick(groups - 1) - pick(0)).alias("long_short"))


def factor_coverage(df: DataFrame, factors: list[str]) -> DataFrame:
    """Share of rows with a close in which each factor is present."""
    return df.filter("close IS NOT NULL").agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in factors]).unpivot([], factors, "factor", "coverage")


def pair_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, corr, cov) of every pair of columns, itself included, over rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def own(a: str, b: str) -> Column:
        has = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(has, F.col(a)), F.when(has, F.col(b))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), correlation(x, y).alias("corr"), F.covar_samp(x, y).alias("cov"))

    return df.agg(F.array(*[own(a, b) for a, b in pairs]).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def high_correlation_pairs(df: DataFrame, columns: list[str], threshold: float = 0.9, least: int = 30, most: int = 50) -> DataFrame:
    """The report of the `most` pairs that correlate most."""
    found = pair_statistics(df, columns).filter((F.col("a") != F.col("b")) & (F.col("n") >= least) & (F.abs("corr") >= threshold))
    return found.orderBy(F.desc(F.abs("corr")), "a", "b").limit(most).select("a", "b", "n", "corr")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, moments and exact quantiles of each column."""
    points = {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}
    found = quantiles(df, {f"{n} {c}": (c, p) for c in columns for n, p in points.items()})
    own = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *[F.first(f"{n} {c}").alias(n) for n in points], F.max(c).alias("max")
    )
    return df.select(*columns).crossJoin(F.broadcast(found)).agg(F.array(*[own(c) for c in columns]).alias("d")).select(F.explode("d").alias("d")).select("d.*")


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    own = lambda c: F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.count("*").alias("total"), F.avg(F.col(c).isNull().cast("double")).alias("fraction"))
    return df.agg(F.array(*[own(c) for c in columns]).alias("d")).select(F.explode("d").alias("d")).select("d.*")


def temporal_correlation(df: DataFrame, a: str, b: str, key: str = "ts_code") -> DataFrame:
    rows = both_present(df, a, b).select(key, a, b)
    ranked = rows.withColumns({"__a": average_rank(a, [key]), "__b": average_rank(b, [key])})
    return ranked.groupBy(key).agg(F.count("*").alias("n"), correlation(a, b).alias("pearson"), correlation("__a", "__b").alias("spearman"))


def univariate_ols(df: DataFrame, x: str, y: str, key: str | None = None) -> DataFrame:
    """Slope, intercept and R2 of y on x, for all rows or each key."""
    rows = both_present(df, x, y)
    grouped = rows.groupBy(key) if key else rows.groupBy()
    fit = grouped.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return fit


def contemporaneous_fit(grid: DataFrame, factor: str) -> DataFrame:
    """The current session's return on the factor."""
    now = F.col("close") / F.lag("close", 1).over(Window.partitionBy("ts_code").orderBy("trade_date")) - 1
    return univariate_ols(grid.withColumn("__r", now), factor, "__r")


def joint_histogram(df: DataFrame, development: DataFrame, a: str, b: str, bins: int = 5) -> DataFrame:
    """Counts and shares of the cells of two columns; edges are quantiles of the development rows, and what lies
    beyond them is in the outer bins."""
    inner = [i / bins for i in range(1, bins)]
    found = quantiles(development, {f"{c}{i}": (column, p) for c, column in (("a", a), ("b", b)) for i, p in enumerate(inner)})
    edges = found.select(*[F.array(*[f"{c}{i}" for i in range(len(inner))]).alias(f"__e{c}") for c in "ab"])
    rows = both_present(df, a, b).crossJoin(F.broadcast(edges))
    place = lambda c, e: F.size(F.filter(e, lambda x: x < F.col(c)))
    cells = rows.select(place(a, "__ea").alias("bin_a"), place(b, "__eb").alias("bin_b")).groupBy("bin_a", "bin_b").agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def forecast_metrics(df: DataFrame) -> DataFrame:
    """From predicted and actual entry and exit moves (p_in, p_out, a_in, a_out): losses averaged within dates, then
    over dates."""
    rows = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("p_in", "p_out", "a_in", "a_out")]))
    e, o = F.col("p_in") - F.col("a_in"), F.col("p_out") - F.col("a_out")
    daily = rows.groupBy("trade_date").agg(
        F.count("*").alias("n"), F.avg(e * e).alias("e2"), F.avg(o * o).alias("o2"), F.avg(F.abs(e)).alias("ea"), F.avg(F.abs(o)).alias("oa"), F.avg(e).alias("eb"), F.avg(o).alias("ob"), F.avg((o - e) * (o - e)).alias("r2"), F.avg(F.col("a_in") * F.col("a_in")).alias("z1"), F.avg(F.col("a_out") * F.col("a_out")).alias("z2")
    )
    mse, zero = (F.avg("e2") + F.avg("o2")) / 2, (F.avg("z1") + F.avg("z2")) / 2
    return daily.agg(
        F.sum("n").alias("observations"), F.count("*").alias("dates"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), ((F.avg("ea") + F.avg("oa")) / 2).alias("mae"), F.avg("eb").alias("entry_bias"), F.avg("ob").alias("exit_bias"),
        F.sqrt(F.avg("e2")).alias("entry_rmse"), F.sqrt(F.avg("o2")).alias("exit_rmse"), F.sqrt(F.avg("r2")).alias("remaining_rmse"), zero.alias("no_change_mse"), (zero - mse).alias("improvement"), F.when(zero > 1e-20, 1 - mse / zero).alias("relative_improvement"),
    )


def return_metrics(df: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """One row of errors, improvement over a zero forecast (also as a share of its error) and both correlations. Ranks are
    mean places among all rows."""
    rows = both_present(df, predicted, actual).select(F.col(predicted).cast("double").alias("p"), F.col(actual).cast("double").alias("a"))
    ranked = rows.join(mean_ranks(rows, "p").withColumnRenamed("rank", "rp"), "p").join(mean_ranks(rows, "a").withColumnRenamed("rank", "ra"), "a")
    e = F.col("p") - F.col("a")
    one = ranked.agg(
        F.count("*").alias("observations"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(F.col("a") * F.col("a")).alias("zero_mse"),
        F.var_pop("a").alias("v"), correlation("p", "a").alias("pearson"), correlation("rp", "ra").alias("spearman"),
    )
    gain = F.when(F.col("zero_mse") > 1e-20, 1 - F.col("mse") / F.col("zero_mse"))
    r2 = F.when(F.col("v") > 1e-20, 1 - F.col("mse") / F.col("v"))
    return one.select("observations", "mse", F.sqrt("mse").alias("rmse"), "mae", "bias", "zero_mse", r2.alias("r2"), (F.col("zero_mse") - F.col("mse")).alias("improvement"), gain.alias("relative_improvement"), "pearson", "spearman")


def training_r2(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """R2 with every date weighing alike."""
    rows = both_present(df, predicted, actual)
    sums = rows.groupBy("trade_date").agg(F.avg(actual).alias("m"), F.avg(F.col(actual) * F.col(actual)).alias("s"), F.avg((F.col(actual) - F.col(predicted)) ** 2).alias("e"))
    total = F.avg("s") - F.avg("m") * F.avg("m")
    return sums.agg(F.when(total > 1e-20, 1 - F.avg("e") / total).alias("r2"))


def direction_accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return both_present(df, predicted, actual).agg(F.count("*").alias("observations"), F.avg((F.signum(predicted) == F.signum(actual)).cast("double")).alias("accuracy"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def per_target_bias_rmse(df: DataFrame, predicted: str, actual: str, key: str = "ts_code") -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return both_present(df, predicted, actual).groupBy(key).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))


def forecast_rank_report(df: DataFrame, score: str) -> DataFrame:
    """Rank (best first, ties averaged) and percentile of each score within its day, and whether it is the latest day."""
    rows = df.filter(F.col(score).isNotNull())
    day = Window.partitionBy("trade_date")
    ties = (F.count("*").over(Window.partitionBy("trade_date", score)) - 1) / 2
    up, down = F.rank().over(day.orderBy(score)) + ties, F.rank().over(day.orderBy(F.desc(score))) + ties
    latest = rows.agg(F.max("trade_date").alias("__latest"))
    made = rows.withColumns({"rank": down, "percentile": up / F.count("*").over(day)})
    return made.crossJoin(F.broadcast(latest)).withColumn("is_latest", F.col("trade_date") == F.col("__latest")).drop("__latest")


def date_cluster_stats(df: DataFrame) -> DataFrame:
    """Each date's mean loss improvement over no change, and mean realised less predicted moves."""
    e, o = F.col("a_in") - F.col("p_in"), F.col("a_out") - F.col("p_out")
    gain = (F.col("a_in") ** 2 + F.col("a_out") ** 2 - e * e - o * o) / 2
    rows = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("p_in", "p_out", "a_in", "a_out")]))
    return rows.groupBy("trade_date").agg(F.avg(gain).alias("loss_improvement"), F.avg(e).alias("entry_bias"), F.avg(o).alias("exit_bias"), F.avg(o - e).alias("remaining_bias"))


def block_length(n: int, horizon: int, step: int) -> int:
    return max(2, math.ceil((horizon + 1) / step), math.ceil(round(n ** (1 / 3), 9)))


def block_bootstrap_ci(daily: DataFrame, metrics: list[str], horizon: int, step: int, replications: int = 1000, seed: int = 17) -> DataFrame:
    """(block, metric, estimate, lower, upper): 95 % percentile intervals of date means by circular blocks, at the
    declared block length, half of it and twice it; lengths with fewer than eight blocks, and series of fewer than
    forty dates, give nothing.

    Replications run in parallel. Each draws hashed block starts; a block's sum is the difference of two running sums of the
    dates in a circle, so a replication costs its blocks, not its dates.
    """
    dates = daily.select("trade_date", *metrics).filter(reduce(Column.__and__, [F.col(m).isNotNull() for m in metrics]))
    numbered = dates.withColumn("__i", (F.row_number().over(Window.orderBy("trade_date")) - 1).cast("long")).drop("trade_date")
    n = dates.count()
    length = block_length(max(n, 1), horizon, step)
    overlap = math.ceil((horizon + 1) / step)
    lengths = [c for c in sorted({max(2, overlap, length // 2), length, 2 * length}) if n >= max(40, 8 * length) and n >= 8 * c]
    spark = daily.sparkSession
    out = spark.createDataFrame([], "block int, metric string, estimate double, lower double, upper double")
    if not lengths:
        return out
    observed = numbered.agg(*[F.avg(m).alias(m) for m in metrics]).unpivot([], metrics, "metric", "estimate")
    circle = numbered.unionByName(numbered.filter(F.col("__i") < max(lengths)).withColumn("__i", F.col("__i") + n))
    before = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    sums = circle.select("__i", *[F.coalesce(F.sum(m).over(before), F.lit(0.0)).alias(m) for m in metrics])  # as long as the calendar
    first, last = ([F.col(m).alias(f"__{k}_{m}") for m in metrics] for k in "ab")
    for size in lengths:
        blocks = math.ceil(n / size)
        draws = spark.range(replications).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        starts = draws.withColumn("__a", F.pmod(F.xxhash64(F.lit(f"{seed}/{size}"), "rep", "b"), F.lit(n)))
        ends = starts.withColumn("__b", F.col("__a") + F.least(F.lit(size), n - F.col("b") * size))
        met = ends.join(F.broadcast(sums.select(F.col("__i").alias("__a"), *first)), "__a").join(F.broadcast(sums.select(F.col("__i").alias("__b"), *last)), "__b")
        means = met.groupBy("rep").agg(*[(F.sum(F.col(f"__b_{m}") - F.col(f"__a_{m}")) / n).alias(m) for m in metrics]).unpivot(["rep"], metrics, "metric", "value")
        bounds = means.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"))
        out = out.unionByName(bounds.join(observed, "metric").select(F.lit(size).alias("block"), "metric", "estimate", "lower", "upper"))
    return out


def input_coverage(df: DataFrame, features: list[str], reason: str = "reason") -> DataFrame:
    """Origins by reason, with the count of rows that have each feature."""
    return df.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_rows"), *[F.count(f).alias(f) for f in features])
