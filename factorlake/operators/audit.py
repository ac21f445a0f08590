"""Reconciliation jobs and report queries. Checks return the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near(a: Column, b: Column, absolute: float = 1e-7, relative: float = 2e-11) -> Column:
    """Equal within tolerance; two nulls are equal, one is not."""
    close = F.abs(a - b) <= absolute + relative * F.greatest(F.abs(a), F.abs(b))
    return F.coalesce(close, a.isNull() & b.isNull())


def check_forecast_identities(rows: DataFrame) -> DataFrame:
    """Forecast rows whose edge, change, basis points or error don't follow from their levels."""
    c = F.col
    rules = {
        "edge": near(c("edge"), c("expected_exit") - c("expected_entry")),
        "expected_change": near(c("expected_change"), (c("expected_exit") - c("state")) / c("scale")),
        "bps": near(c("bps"), (c("expected_exit") - c("expected_entry")) / c("scale") * 10000, 1e-5),
        "error": near(c("error"), c("expected_exit") - c("realized_exit")),
    }
    broken = F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()])), ",")
    return rows.withColumn("broken", broken).filter("broken <> ''")


def check_return_rows(rows: DataFrame) -> DataFrame:
    """Rows of a return study: response x scale is the return, the price follows from it, the residual is their
    difference, the interval runs forward."""
    c = F.col
    rules = {
        "response": near(c("response") * c("scale"), c("observed_return")),
        "price": c("observed_return").isNull() | near(c("end_price"), c("origin_price") * (1 + c("observed_return")), 1e-6, 1e-9),
        "residual": near(c("residual"), c("response") - c("predicted")),
        "interval": F.coalesce(c("start_date") < c("end_date"), F.lit(True)),
    }
    broken = F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()])), ",")
    return rows.withColumn("broken", broken).filter("broken <> ''")


def compare_columns(reported: DataFrame, rebuilt: DataFrame, keys: list[str], columns: list[str], absolute: float = 1e-10, relative: float = 1e-12) -> DataFrame:
    """(keys, column, reported, rebuilt): values that differ, rows that only one side has among them."""
    a = reported.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = rebuilt.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    both = a.join(b, keys, "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__a_{c}").cast("double").alias("reported"), F.col(f"__b_{c}").cast("double").alias("rebuilt"), (F.col("__a").isNotNull() & F.col("__b").isNotNull() & near(F.col(f"__a_{c}"), F.col(f"__b_{c}"), absolute, relative)).alias("same")) for c in columns])
    return both.select(*keys, F.explode(each).alias("d")).filter("NOT d.same").select(*keys, "d.column", "d.reported", "d.rebuilt")


def reconcile_ledger(trades: DataFrame, ledger: DataFrame, closes: DataFrame, calendar: DataFrame, capital: float) -> DataFrame:
    """(trade_date, problem): days on which cash or net worth rebuilt from trades differs from the ledger, days without
    a ledger row and ledger rows off the calendar.

    trades (trade_date, ts_code, quantity signed, price, fee); ledger (trade_date, cash, nav).
    """
    spent = trades.groupBy("trade_date").agg(F.sum(F.col("quantity") * F.col("price") + F.col("fee")).alias("spent"))
    days = calendar.select("trade_date")
    upto = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    cash = days.join(spent, "trade_date", "left").withColumn("own_cash", capital - F.sum(F.coalesce("spent", F.lit(0.0))).over(upto))
    moved = trades.groupBy("trade_date", "ts_code").agg(F.sum("quantity").alias("q"))
    held = closes.join(moved, ["trade_date", "ts_code"], "full_outer").withColumn("held", F.sum(F.coalesce("q", F.lit(0.0))).over(Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))
    worth = held.groupBy("trade_date").agg(F.sum(F.col("held") * F.coalesce("close", F.lit(0.0))).alias("worth"))
    own = cash.join(worth, "trade_date", "left").select("trade_date", "own_cash", (F.col("own_cash") + F.coalesce("worth", F.lit(0.0))).alias("own_nav"), F.lit(True).alias("__day"))
    both = own.join(ledger.withColumn("__row", F.lit(True)), "trade_date", "full_outer")
    problem = F.when(F.col("__row").isNull(), "missing").when(F.col("__day").isNull(), "off_calendar").when(~near(F.col("own_cash"), F.col("cash"), 1e-4, 1e-9), "cash").when(~near(F.col("own_nav"), F.col("nav"), 1e-4, 1e-9), "nav")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("trade_date", "problem")


def check_complete_domain(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): origins that are missing, extra or repeated.

    Keys are dealt out before they are counted: most are single, so tasks that count first would hold what they read."""
    both = expected.select(*keys, F.lit(True).alias("__e"), F.lit(0).alias("__n")).unionByName(rows.select(*keys, F.lit(False).alias("__e"), F.lit(1).alias("__n")))
    # As in a join, a null key equals none: its rows stay apart by side.
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    apart = both.withColumn("__side", F.when(null, F.col("__e")))
    told = apart.repartition(*keys).groupBy(*keys, "__side").agg(F.max("__e").alias("__e"), F.sum("__n").alias("n"))
    problem = F.when(F.col("n") == 0, "missing").when(~F.col("__e"), "extra").when(F.col("n") > 1, "repeated")
    return told.withColumn("problem", problem).filter("problem IS NOT NULL").select(*keys, "problem")


def check_references(rows: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(reference, value, n): values of each reference column that its parent doesn't hold."""
    parts = [rows.filter(F.col(c).isNotNull()).join(p.select(c).distinct(), c, "left_anti").groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("reference"), "value", "n") for c, p in parents.items()]
    return reduce(DataFrame.unionByName, parts)


def check_collection_counts(collections: DataFrame, manifest: DataFrame) -> DataFrame:
    """Collections whose rows are not as many as declared."""
    counted = collections.groupBy("collection").agg(F.count("*").alias("actual"))
    both = manifest.select("collection", F.col("n_rows").alias("declared")).join(counted, "collection", "full_outer")
    return both.filter(~F.col("declared").eqNullSafe(F.col("actual")))


def check_one_per_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n <> 1")


def page_filter(rows: DataFrame, start: str | None = None, end: str | None = None, **equal) -> DataFrame:
    """Rows in a range of dates whose columns have the given values (a list: any of them)."""
    conditions = [F.col("trade_date") >= F.lit(start).cast("date")] if start else []
    conditions += [F.col("trade_date") <= F.lit(end).cast("date")] if end else []
    conditions += [F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in equal.items()]
    return reduce(lambda df, c: df.filter(c), conditions, rows)


def latest_per_group(rows: DataFrame, order: str, groups: list[str]) -> DataFrame:
    names = [c for c in rows.columns if c not in groups]
    return rows.groupBy(*groups).agg(F.max_by(F.struct(*names), order).alias("r")).select(*groups, "r.*")


def risk_event_filter(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger rows that are flagged or have an event on their date."""
    dates = events.select("trade_date").distinct().withColumn("__e", F.lit(True))
    return ledger.join(dates, "trade_date", "left").filter(F.col("flagged") | F.col("__e").isNotNull()).drop("__e")


def order_limit_offset(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a report, with the count of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def attach_related(rows: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    """Rows with their target's attributes and the number of events on their date."""
    counts = events.groupBy("trade_date").agg(F.count("*").alias("n_events"))
    return rows.join(targets, "ts_code", "left").join(counts, "trade_date", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def downsample_series(rows: DataFrame, most: int, order: str = "trade_date") -> DataFrame:
    """At most `most` evenly spaced rows, both ends among them. One series, as long as a calendar."""
    w = Window.orderBy(order)
    numbered = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy())})
    m = F.least(F.col("__n"), F.lit(most))
    places = F.transform(F.sequence(F.lit(0), m.cast("int") - 1), lambda j: F.floor(j * (F.col("__n") - 1) / F.greatest(m - 1, F.lit(1)) + 0.5))
    return numbered.filter(F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def collection_counts(collections: DataFrame) -> DataFrame:
    return collections.groupBy("collection").agg(F.count("*").alias("n_rows"))


def state_event_filter(states: DataFrame, names: list[str], symbols: list[str] | None = None, ok: bool | None = None) -> DataFrame:
    found = states.filter(F.col("state").isin(*names))
    found = found.filter(F.col("ts_code").isin(*symbols)) if symbols else found
    return found if ok is None else found.filter(F.col("value").isNotNull() if ok else F.col("value").isNull())


def catalog_search(rows: DataFrame, text: str, column: str, limit: int, **equal) -> DataFrame:
    """A page of a catalogue: rows whose column holds the text, whatever its case."""
    return page_filter(rows, **equal).filter(F.contains(F.lower(F.col(column)), F.lit(text.lower()))).orderBy(column).limit(limit)


def compare_runs(runs: DataFrame, metric_columns: list[str]) -> DataFrame:
    """Runs side by side with the first one: differences of metrics, and whether data, target and universe agree."""
    first = runs.orderBy("run_id").limit(1)
    base = first.select(*[F.col(c).alias(f"__{c}") for c in [*metric_columns, "data_hash", "target", "universe"]])
    both = runs.crossJoin(F.broadcast(base))
    return both.select("run_id", *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_change") for c in metric_columns], *[F.col(c).eqNullSafe(F.col(f"__{c}")).alias(f"same_{c}") for c in ("data_hash", "target", "universe")])
