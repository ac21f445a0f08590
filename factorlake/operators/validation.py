"""Time-ordered validation: holdouts, folds, purging, choice of models, refits and forecast rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holdout_split(calendar: DataFrame, fraction: float = 0.2, test_start: str | None = None, least: int = 10) -> DataFrame:
    """Sessions with is_holdout: the last part of them, or those from a date on."""
    numbered = calendar.select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("__i"), F.count("*").over(Window.partitionBy()).alias("__n"))
    late = F.col("trade_date") >= F.lit(test_start).cast("date") if test_start else F.col("__i") >= F.floor(F.col("__n") * (1 - fraction))
    made = numbered.withColumn("is_holdout", late)
    made = made.withColumn("__held", F.sum(F.col("is_holdout").cast("int")).over(Window.partitionBy()))
    return made.filter(F.col("__held") >= least).select("trade_date", "is_holdout")


def expanding_folds(calendar: DataFrame, count: int, first: int) -> DataFrame:
    """(fold, test_start, test_end): after `first` sessions, consecutive test blocks of one size; the last takes the
    rest. A fold trains on all sessions before its block."""
    numbered = calendar.select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    size = F.floor((F.col("n") - first) / count)
    fold = F.least(F.floor((F.col("i") - first) / size), F.lit(count - 1))
    return numbered.filter(F.col("i") >= first).groupBy(fold.cast("int").alias("fold")).agg(F.min("trade_date").alias("test_start"), F.max("trade_date").alias("test_end"), F.count("*").alias("n_sessions"))


def in_folds(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """Each sample once for each fold that it is in: role `train` if its label ended before the block starts, `purged`
    if it began before and did not, `test` within the block. The folds' table has a row for each fold."""
    joined = samples.join(F.broadcast(folds.select("fold", "test_start", "test_end")), F.col("trade_date") <= F.col("test_end"))
    role = F.when(F.col("trade_date") >= F.col("test_start"), "test").when(F.col("label_end") < F.col("test_start"), "train").otherwise("purged")
    return joined.withColumn("role", role)


def purge_counts(samples: DataFrame, folds: DataFrame) -> DataFrame:
    return in_folds(samples, folds).groupBy("fold", "role").agg(F.count("*").alias("n_rows"))


def train_window(samples: DataFrame, cutoff: str, window: int) -> DataFrame:
    """Rows of the last `window` dates whose labels ended before the cutoff."""
    at = F.lit(cutoff).cast("date")
    mature = samples.filter((F.col("trade_date") < at) & (F.col("label_end") < at))
    dates = mature.select("trade_date").distinct().withColumn("__r", F.row_number().over(Window.orderBy(F.desc("trade_date")))).filter(F.col("__r") <= window)
    return mature.join(F.broadcast(dates.select("trade_date")), "trade_date", "left_semi")


def one_se_rule(trials: DataFrame) -> DataFrame:
    """From (id, score, se, complexity, status): the least complex of the trials whose score is at most the best plus
    its standard error; ties by id. One row; trials are a handful."""
    valid = trials.filter("status = 'valid' AND score IS NOT NULL")
    best = valid.orderBy("score", "complexity", "id").limit(1).select(F.col("score").alias("__best"), F.coalesce("se", F.lit(0.0)).alias("__se"))
    near = valid.crossJoin(F.broadcast(best)).filter(F.col("score") <= F.col("__best") + F.col("__se"))
    return near.orderBy("complexity", "id").limit(1).drop("__best", "__se")


def best_ic_choice(trials: DataFrame) -> DataFrame:
    """The trial of the highest mean IC; the first of equals."""
    return trials.filter("status = 'complete' AND score IS NOT NULL").orderBy(F.desc("score"), "place").limit(1)


def refit_dates(calendar: DataFrame, start: str, every: int) -> DataFrame:
    """(trade_date, refit_date): each session from the start on with the refit that serves it."""
    own = calendar.filter(F.col("trade_date") >= F.lit(start).cast("date")).select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("__i"))
    block = F.floor(F.col("__i") / every)
    return own.withColumn("refit_date", F.min("trade_date").over(Window.partitionBy(block))).drop("__i")


def forecast_rows(df: DataFrame, fit_id: str = "fit") -> DataFrame:
    """Forecasts in prices: from state, scale, predicted and actual moves (p_in, p_out, a_in, a_out) and the label's end.

    Levels, edge, change, error and status, and an id that is the hash of what names the row."""
    level = lambda c: F.col("state") + F.col("scale") * F.col(c)
    made = df.withColumns({"expected_entry": level("p_in"), "expected_exit": level("p_out"), "realized_entry": level("a_in"), "realized_exit": level("a_out")})
    status = F.when(F.col("state").isNull(), "invalid").when(F.col("p_out").isNull(), "no_model").when(F.col("realized_exit").isNull(), "open").otherwise("matured")
    ident = F.sha2(F.concat_ws("|", F.col("trade_date").cast("string"), "ts_code", F.lit(fit_id)), 256)
    return made.withColumns({
        "id": ident, "edge": F.col("expected_exit") - F.col("expected_entry"), "expected_change": F.col("p_out"), "bps": (F.col("p_out") - F.col("p_in")) * 10000, "error": F.col("expected_exit") - F.col("realized_exit"), "status": status,
    })


def training_plot_sample(df: DataFrame, most: int = 96, key: str = "ts_code") -> DataFrame:
    """At most `most` evenly spaced rows of each key, both ends among them: a report's plot."""
    w = Window.partitionBy(key)
    numbered = df.withColumns({"__i": F.row_number().over(w.orderBy("trade_date")) - 1, "__n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.least(F.col("__n"), F.lit(most)).cast("int") - 1), lambda j: F.floor(j * (F.col("__n") - 1) / F.greatest(F.least(F.col("__n"), F.lit(most)) - 1, F.lit(1)) + 0.5))
    return numbered.filter(F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def factor_increment(with_factors: DataFrame, without: DataFrame, keys: tuple[str, ...] = ("trade_date", "ts_code")) -> DataFrame:
    """Daily losses of two sets of forecasts on the origins that both have (error column), and how many each covers."""
    a, b = with_factors.select(*keys, F.col("error").alias("ea")), without.select(*keys, F.col("error").alias("eb"))
    both = a.join(b, list(keys), "full_outer")
    matched = F.col("ea").isNotNull() & F.col("eb").isNotNull()
    return both.groupBy("trade_date").agg(
        F.count(F.when(matched, 1)).alias("matched"), F.count("ea").alias("with_factors"), F.count("eb").alias("without"), F.avg(F.when(matched, F.col("ea") ** 2)).alias("mse_with"), F.avg(F.when(matched, F.col("eb") ** 2)).alias("mse_without")
    )


def all_present(columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
