"""Labels measured on later sessions, basket states, and features of states. All leads and lags are sessions of
the complete grid: a missing session gives a null, never a bridge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def by(key: str) -> Window:
    return Window.partitionBy(key).orderBy("trade_date")


def _full(x: Column, f, key: str, first: int, last: int, n: int) -> Column:
    w = by(key).rowsBetween(first, last)
    return F.when(F.count(x).over(w) == n, f(x).over(w))


def forward_return(grid: DataFrame, h: int) -> DataFrame:
    w = by("ts_code")
    entry, leave = F.lead("open", 1).over(w), F.lead("open", h + 1).over(w)
    return grid.withColumn("label", F.when(F.abs(entry) > TINY, leave / entry - 1))


def forward_excess_return(grid: DataFrame, h: int) -> DataFrame:
    made = forward_return(grid, h)
    return made.withColumn("label", F.col("label") - F.avg("label").over(Window.partitionBy("trade_date")))


def label_end_date(df: DataFrame, calendar: DataFrame, h: int) -> DataFrame:
    ends = calendar.select("trade_date", F.lead("trade_date", h + 1).over(Window.orderBy("trade_date")).alias("label_end"))
    return df.join(F.broadcast(ends), "trade_date", "left")


def sample_valid(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    return df.withColumn("valid", F.coalesce(*[F.col(c) for c in features]).isNotNull() & F.col(label).isNotNull() & F.col("close").isNotNull())


def observation_sampling(df: DataFrame, step: int, warm_up: int) -> DataFrame:
    return df.filter((F.col("session_index") >= warm_up) & ((F.col("session_index") - warm_up) % step == 0))


def asset_price_labels(grid: DataFrame, h: int) -> DataFrame:
    """State, scale and the moves to the entry and exit opens, over the scale."""
    w = by("ts_code")
    scale = F.abs("close")
    made = grid.withColumns({"state": F.col("close"), "scale": scale})
    move = lambda n: F.when(scale > TINY, (F.lead("open", n).over(w) - F.col("close")) / scale)
    return made.withColumns({"entry": move(1), "exit": move(1 + h)})


def legs(grid: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's legs on each session, with the number of legs that it has."""
    sized = targets.withColumn("n_legs", F.count("*").over(Window.partitionBy("target_id")))
    return grid.join(sized, "ts_code")


def basket_state(grid: DataFrame, targets: DataFrame, past: int = 61) -> DataFrame:
    """Value and gross value of each target by session; null unless every leg has a close on the last `past` sessions."""
    whole = F.count("close").over(by("ts_code").rowsBetween(-(past - 1), 0)) == past
    rows = legs(grid.withColumn("__whole", whole), targets)
    complete = (F.count(F.when(F.col("__whole"), 1)) == F.first("n_legs")) & (F.count("close") == F.first("n_legs"))
    return rows.groupBy("target_id", "trade_date").agg(
        F.when(complete, F.sum(F.col("quantity") * F.col("close"))).alias("state"), F.when(complete, F.sum(F.abs(F.col("quantity") * F.col("close")))).alias("gross")
    )


def basket_labels(grid: DataFrame, targets: DataFrame, h: int) -> DataFrame:
    """The same quantities at the entry and exit opens, less the state, over its gross."""
    w = by("ts_code")
    moved = grid.withColumns({"__in": F.lead("open", 1).over(w), "__out": F.lead("open", 1 + h).over(w)})
    rows = legs(moved, targets)

    def value(c: str) -> Column:
        return F.when(F.count(c) == F.first("n_legs"), F.sum(F.col("quantity") * F.col(c)))

    made = rows.groupBy("target_id", "trade_date").agg(value("close").alias("state"), F.when(F.count("close") == F.first("n_legs"), F.sum(F.abs(F.col("quantity") * F.col("close")))).alias("gross"), value("__in").alias("i"), value("__out").alias("o"))
    over = lambda c: F.when(F.col("gross") > TINY, (F.col(c) - F.col("state")) / F.col("gross"))
    return made.select("target_id", "trade_date", "state", "gross", over("i").alias("entry"), over("o").alias("exit"))


def fixed_basket(spark, target_id: str, quantities: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(target_id, c, float(q)) for c, q in quantities.items()], "target_id string, ts_code string, quantity double")


def pair_ols_basket(grid: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """(pair_id, trade_date, beta): slope of the first leg on the second over the `window` sessions before."""
    a = grid.select(F.col("ts_code").alias("first"), "trade_date", F.col("close").alias("y"))
    b = grid.select(F.col("ts_code").alias("second"), "trade_date", F.col("close").alias("x"))
    rows = pairs.join(a, "first").join(b, ["second", "trade_date"])
    w = by("pair_id").rowsBetween(-window, -1)
    both = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)
    var = F.var_pop("x").over(w)
    beta = F.when((F.count(both).over(w) == window) & (var > TINY), F.covar_pop("x", "y").over(w) / var)
    return rows.withColumn("beta", beta).select("pair_id", "trade_date", "beta")


def asset_return_response(grid: DataFrame, h: int, mode: str = "forecast") -> DataFrame:
    w = by("ts_code")
    now = F.col("close")
    made = F.lead("close", h).over(w) / now - 1 if mode == "forecast" else now / F.lag("close", h).over(w) - 1
    return grid.withColumn("response", made)


def response_scale(grid: DataFrame, window: int, h: int, mode: str = "forecast") -> DataFrame:
    """Sample deviation of `window` one-session returns times the root of h, as of the start of the response's interval:
    the origin for a forecast, h sessions before it for an association. Null if not above 1e-8 times the root."""
    w = by("ts_code")
    r = F.col("close") / F.lag("close", 1).over(w) - 1
    made = grid.withColumn("__r", r)
    scale = _full(F.col("__r"), F.stddev_samp, "ts_code", -(window - 1), 0, window) * F.sqrt(F.lit(float(h)))
    made = made.withColumn("scale", F.when(scale > 1e-8 * float(h) ** 0.5, scale)).drop("__r")
    return made if mode == "forecast" else made.withColumn("scale", F.lag("scale", h).over(w))


def invalid_reason(df: DataFrame, features: list[str], h: int, mode: str = "forecast", family: str = "ridge", events: list[str] | None = None, reports: list[str] | None = None) -> DataFrame:
    """The first reason against a sample; null for none.

    The response runs from the origin to `h` sessions later, or, for an association, from `h` sessions before: its price
    then counts, and the first sessions have none. Only the event family needs one of `events` to be other than 0, only the
    fundamental family one of `reports`, its features made of statements."""
    lacking = lambda names: reduce(Column.__and__, [F.col(c).isNull() for c in names])
    start = F.col("close") if mode == "forecast" else F.lag("close", h).over(Window.partitionBy("ts_code").orderBy("trade_date"))
    reasons = [
        F.when(F.col("session_index") < h, F.lit("response_window_warmup")) if mode != "forecast" else None,
        F.when(start.isNull(), F.lit("missing_origin_price")),
        F.when(F.col("scale").isNull(), F.lit("response_normalizer_unavailable")),
        F.when(lacking(features), F.lit("no_observed_factor_input")),
    ]
    if family == "event":
        seen = reduce(Column.__or__, [F.coalesce(F.abs(F.col(c)) > 1e-12, F.lit(False)) for c in events or []], F.lit(False))
        reasons.append(F.when(~seen, F.lit("no_observed_event")))
    if family == "fundamental":
        reasons.append(F.when(lacking(reports) if reports else F.lit(True), F.lit("no_observed_fundamental_predictor")))
    return df.withColumn("reason", F.coalesce(*[r for r in reasons if r is not None]))


def input_offset(df: DataFrame, column: str, k: int) -> DataFrame:
    """A feature k sessions after (or before, below 0) the origin."""
    if not -252 <= k <= 252:
        raise ValueError("an offset has at most 252 sessions")
    w = by("ts_code")
    return df.withColumn(column, F.lead(column, k).over(w) if k > 0 else F.lag(column, -k).over(w) if k < 0 else F.col(column))


def input_availability(df: DataFrame, inputs: list[str], label_end: str = "label_end") -> DataFrame:
    """available_at is the latest available date of a row's inputs, ready_at also waits for the label."""
    dates = [F.col(f"{c}__available_date") for c in inputs]
    latest = F.greatest(*dates) if len(dates) > 1 else dates[0]
    evidence = F.map_from_arrays(F.array(*[F.lit(c) for c in inputs]), F.array(*[d.cast("string") for d in dates]))
    return df.withColumns({"available_at": latest, "ready_at": F.greatest(latest, F.col(label_end)), "evidence": evidence})


def availability_class(df: DataFrame) -> DataFrame:
    made = (
        F.when(F.col("available_at").isNull(), "unresolved").when(~F.coalesce(F.col("verified"), F.lit(False)), "unverified").when(F.col("available_at") <= F.col("trade_date"), "origin_known").otherwise("conditional_realised")
    )
    return df.withColumn("availability_class", made)


def pair_valuation(grid: DataFrame, targets: DataFrame, dates: DataFrame) -> DataFrame:
    """Value of each target on each wanted date and its status: complete, missing_legs or outside_calendar."""
    wanted = targets.select("target_id").distinct().crossJoin(F.broadcast(dates.select("trade_date").distinct()))
    rows = legs(grid, targets).groupBy("target_id", "trade_date").agg(F.count("close").alias("n"), F.first("n_legs").alias("n_legs"), F.sum(F.col("quantity") * F.col("close")).alias("v"))
    found = wanted.join(rows, ["target_id", "trade_date"], "left")
    status = F.when(F.col("n").isNull(), "outside_calendar").when(F.col("n") < F.col("n_legs"), "missing_legs").otherwise("complete")
    return found.select("target_id", "trade_date", status.alias("status"), F.when(status == "complete", F.col("v")).alias("value"))


def label_is_mature(df: DataFrame, cutoff: str) -> DataFrame:
    at = F.lit(cutoff).cast("date")
    return df.withColumn("mature", F.coalesce((F.col("trade_date") < at) & (F.col("label_end") < at) & F.col("label").isNotNull(), F.lit(False)))


def state_features(df: DataFrame, kind: str, key: str = "ts_code", state: str = "close") -> DataFrame:
    """Features of a state: reversion (distance from means, last change), trend (changes), other (short changes).
    Each is over the state's size (`gross`, or its absolute value)."""
    x = F.col(state)
    size = F.col("gross") if "gross" in df.columns else F.abs(x)
    change = lambda n: x - F.lag(x, n).over(by(key))
    away = lambda n: x - _full(x, F.avg, key, -(n - 1), 0, n)
    made = {"reversion": {"away20": away(20), "away60": away(60), "change1": change(1)}, "trend": {f"change{n}": change(n) for n in (1, 5, 20, 60)}, "other": {f"change{n}": change(n) for n in (1, 5)}}[kind]
    return df.withColumns({name: F.when(size > TINY, v / size) for name, v in made.items()})


def volatility20(df: DataFrame, key: str = "ts_code", state: str = "close") -> DataFrame:
    size = F.col("gross") if "gross" in df.columns else F.abs(F.col(state))
    made = df.withColumn("__d", F.col(state) - F.lag(state, 1).over(by(key)))
    return made.withColumn("volatility20", F.when(size > TINY, _full(F.col("__d"), F.stddev_samp, key, -19, 0, 20) / size)).drop("__d")


def basket_factor(grid: DataFrame, targets: DataFrame, factor: str) -> DataFrame:
    """A factor of a target: its legs' factors, weighed by their share of the gross value; null if a leg lacks it."""
    rows = legs(grid, targets).withColumn("__v", F.col("quantity") * F.col("close"))
    complete = F.count(F.when(F.col(factor).isNotNull() & F.col("close").isNotNull(), 1)) == F.first("n_legs")
    return rows.groupBy("target_id", "trade_date").agg(F.when(complete, F.sum(F.col("__v") * F.col(factor)) / F.sum(F.abs("__v"))).alias("factor"))


def event_flag(grid: DataFrame, targets: DataFrame, events: list[str]) -> DataFrame:
    rows = legs(grid, targets)
    hit = F.greatest(*[F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in events], F.lit(0.0)) > TINY
    return rows.groupBy("target_id", "trade_date").agg(F.max(hit).alias("event"))


def origin_domain(calendar: DataFrame, targets: DataFrame, h: int) -> DataFrame:
    """The rows that a study must have, from the calendar alone."""
    w = Window.orderBy("trade_date")
    dates = calendar.select("trade_date", F.lead("trade_date", 1).over(w).alias("entry_date"), F.lead("trade_date", 1 + h).over(w).alias("exit_date"))
    return targets.select("target_id").distinct().crossJoin(F.broadcast(dates))
