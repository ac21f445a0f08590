"""Queries of reconciliation jobs and report pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import audit, labels
from ..sources import adapter
from .factor_queries import grid_of
from .label_queries import FEATURES, LABEL_SQL, sessions
from .model_queries import ROWS_SQL, forecast_table
from .registry import register, rounded, rounded_sql
from .source_queries import number, select_round

P, S = adapter.PANEL_SQL, adapter.SECURITIES_SQL
K = ("ts_code", "trade_date")
W = "(PARTITION BY ts_code ORDER BY trade_date)"
N = "substr(ts_code, 2)::BIGINT"


def _faulty(s: SparkSession, d: str) -> DataFrame:
    rows = forecast_table(s, d)
    return rows.withColumns({"edge": F.when(number() % 5 == 2, F.col("edge") + 1).otherwise(F.col("edge")), "error": F.when(number() % 7 == 3, F.col("error") * 2 + 1).otherwise(F.col("error"))})


register(
    "check_forecast_identities",
    lambda s, d: audit.check_forecast_identities(_faulty(s, d)).select(*K, "broken"),
    f"""WITH {ROWS_SQL} SELECT ts_code, trade_date, concat_ws(',', CASE WHEN {N} % 5 = 2 AND edge IS NOT NULL THEN 'edge' END, CASE WHEN {N} % 7 = 3 AND error IS NOT NULL THEN 'error' END) AS broken FROM forecast_rows
    WHERE ({N} % 5 = 2 AND edge IS NOT NULL) OR ({N} % 7 = 3 AND error IS NOT NULL)""",
)


def _returns(s: SparkSession, d: str) -> DataFrame:
    w = labels.by("ts_code")
    made = grid_of(s, d).withColumns({"origin_price": F.col("close"), "end_price": F.lead("close", 3).over(w), "start_date": F.col("trade_date"), "end_date": F.date_add("trade_date", 42)})
    made = made.withColumn("observed_return", F.col("end_price") / F.col("origin_price") - 1).withColumn("scale", F.lit(2.0))
    made = made.withColumn("response", F.col("observed_return") / 2).withColumn("predicted", F.col("response") * 0.5)
    return made.withColumns({"residual": F.col("response") - F.col("predicted") + F.when(number() % 4 == 1, 0.5).otherwise(0.0), "end_date": F.when(number() % 6 == 5, F.col("start_date")).otherwise(F.col("end_date"))})


register(
    "check_return_rows",
    lambda s, d: audit.check_return_rows(_returns(s, d)).select(*K, "broken"),
    f"""WITH {P}, t AS (SELECT ts_code, trade_date, lead(close, 3) OVER {W} / close IS NOT NULL AS seen FROM grid) SELECT ts_code, trade_date, concat_ws(',', CASE WHEN seen AND {N} % 4 = 1 THEN 'residual' END, CASE WHEN {N} % 6 = 5 THEN 'interval' END) AS broken FROM t WHERE seen AND {N} % 4 = 1 OR {N} % 6 = 5""",
)


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    right = labels.forward_return(grid_of(s, d), 2).select(*K, "label")
    wrong = right.filter(number() % 5 != 3).withColumn("label", F.when(number() % 4 == 2, F.col("label") + 0.25).otherwise(F.col("label")))
    return audit.compare_columns(wrong, right, list(K), ["label"])


register(
    "recompute_labels",
    lambda s, d: select_round(_rebuilt(s, d), (*K, "column"), ("reported", "rebuilt")),
    f"""WITH {P}, {LABEL_SQL} SELECT ts_code, trade_date, 'label' AS "column", {rounded_sql(f'CASE WHEN {N} % 5 = 3 THEN NULL ELSE label + 0.25 END')} AS reported, {rounded_sql('label')} AS rebuilt FROM labelled WHERE {N} % 5 = 3 OR ({N} % 4 = 2 AND label IS NOT NULL)""",
)


def _refactored(s: SparkSession, d: str) -> DataFrame:
    made = f.evaluate(grid_of(s, d), {"mom": FEATURES["mom"]}).select(*K, "mom")
    return audit.compare_columns(made.withColumn("mom", F.when(number() % 6 == 4, F.col("mom") * 1.5 + 0.1).otherwise(F.col("mom"))), made, list(K), ["mom"])


register(
    "recompute_factors",
    lambda s, d: select_round(_refactored(s, d), (*K, "column"), ("reported", "rebuilt")),
    f"""WITH {P}, {f.factor_sql({'mom': FEATURES['mom']})} SELECT ts_code, trade_date, 'mom' AS "column", {rounded_sql('mom * 1.5 + 0.1')} AS reported, {rounded_sql('mom')} AS rebuilt FROM factors WHERE {N} % 6 = 4 AND mom IS NOT NULL""",
)


def _trades(s: SparkSession, d: str) -> DataFrame:
    return grid_of(s, d).filter(((F.col("session_index") + number()) % 20 == 0) & F.col("close").isNotNull()).select(*K, F.when(F.col("session_index") % 2 == 0, 10.0).otherwise(-10.0).alias("quantity"), F.col("close").alias("price"), F.lit(1.0).alias("fee"))


def _ledger_audit(s: SparkSession, d: str) -> DataFrame:
    """A ledger rebuilt from the trades, with faults planted by session."""
    grid, trades = grid_of(s, d), _trades(s, d)
    upto = labels.Window.orderBy("trade_date").rowsBetween(labels.Window.unboundedPreceding, 0)
    own = labels.Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(labels.Window.unboundedPreceding, 0)
    held = grid.join(trades.select(*K, "quantity"), list(K), "left").withColumn("held", F.sum(F.coalesce("quantity", F.lit(0.0))).over(own))
    worth = held.groupBy("trade_date", "session_index").agg(F.sum(F.col("held") * F.coalesce("close", F.lit(0.0))).alias("worth"))
    spent = trades.groupBy("trade_date").agg(F.sum(F.col("quantity") * F.col("price") + 1.0).alias("spent"))
    cash = worth.join(spent, "trade_date", "left").withColumn("cash", 1e6 - F.sum(F.coalesce("spent", F.lit(0.0))).over(upto))
    ledger = cash.select("trade_date", "session_index", (F.col("cash") + F.when(F.col("session_index") % 31 == 4, 5.0).otherwise(0.0)).alias("cash"), (F.col("cash") + F.col("worth") + F.when(F.col("session_index") % 37 == 6, 7.0).otherwise(0.0)).alias("nav"))
    kept = ledger.filter("session_index % 41 <> 8").withColumn("trade_date", F.when(F.col("session_index") % 43 == 9, F.date_add("trade_date", 1)).otherwise(F.col("trade_date"))).drop("session_index")
    return audit.reconcile_ledger(trades, kept, grid.select(*K, "close"), sessions(s, d), 1e6)


register(
    "reconcile_ledger",
    _ledger_audit,
    f"""WITH {P} SELECT trade_date, CASE WHEN session_index % 41 = 8 OR session_index % 43 = 9 THEN 'missing' WHEN session_index % 31 = 4 THEN 'cash' ELSE 'nav' END AS problem FROM calendar WHERE session_index % 41 = 8 OR session_index % 43 = 9 OR session_index % 31 = 4 OR session_index % 37 = 6
    UNION ALL SELECT trade_date + 1, 'off_calendar' FROM calendar WHERE session_index % 43 = 9 AND session_index % 41 <> 8""",
)


def _domain(s: SparkSession, d: str) -> DataFrame:
    grid = grid_of(s, d).select(*K, "session_index")
    rows = grid.filter((F.col("session_index") + number()) % 23 != 5)
    rows = rows.unionByName(grid.filter(F.col("session_index") % 29 == 7)).unionByName(grid.filter("session_index = 3").withColumn("trade_date", F.date_add("trade_date", 2)))
    return audit.check_complete_domain(grid, rows, list(K))


register(
    "check_complete_domain",
    _domain,
    f"""WITH {P}, r AS (SELECT ts_code, trade_date FROM grid WHERE (session_index + {N}) % 23 <> 5 UNION ALL SELECT ts_code, trade_date FROM grid WHERE session_index % 29 = 7 UNION ALL SELECT ts_code, trade_date + 2 FROM grid WHERE session_index = 3), c AS (SELECT ts_code, trade_date, count(*) AS n FROM r GROUP BY ALL)
    SELECT ts_code, trade_date, CASE WHEN n IS NULL THEN 'missing' WHEN g.session_index IS NULL THEN 'extra' ELSE 'repeated' END AS problem FROM grid g FULL JOIN c USING (ts_code, trade_date) WHERE n IS NULL OR g.session_index IS NULL OR n > 1""",
)
register(
    "check_references",
    lambda s, d: audit.check_references(adapter.memberships(s, d), {"ts_code": adapter.securities(s, d), "universe_id": adapter.securities(s, d).select(F.col("exchange").alias("universe_id")).distinct()}),
    f"""WITH {S} SELECT 'ts_code' AS reference, ts_code AS value, count(*) AS n FROM memberships WHERE ts_code NOT IN (SELECT ts_code FROM securities) GROUP BY 2 UNION ALL SELECT 'universe_id', universe_id, count(*) FROM memberships WHERE universe_id NOT IN (SELECT exchange FROM securities) GROUP BY 2""",
)


def _collections(s: SparkSession, d: str) -> DataFrame:
    return adapter.table(s, d, "events").select(F.col("event_type").alias("collection"), "event_id", "user_id", "value")


_MANIFEST = "manifest AS (SELECT event_type AS collection, CASE WHEN min(event_id) % 2 = 0 THEN count(*) ELSE count(*) + 1 END AS n_rows FROM events GROUP BY 1 UNION ALL SELECT 'other', 4)"


def _manifest(s: SparkSession, d: str) -> DataFrame:
    made = _collections(s, d).groupBy("collection").agg(F.when(F.min("event_id") % 2 == 0, F.count("*")).otherwise(F.count("*") + 1).alias("n_rows"))
    return made.union(s.createDataFrame([("other", 4)], "collection string, n_rows long"))


register(
    "check_collection_counts",
    lambda s, d: audit.check_collection_counts(_collections(s, d), _manifest(s, d)),
    f"WITH {_MANIFEST}, c AS (SELECT event_type AS collection, count(*) AS actual FROM events GROUP BY 1) SELECT collection, n_rows AS declared, actual FROM manifest FULL JOIN c USING (collection) WHERE n_rows IS DISTINCT FROM actual",
)
register("check_one_target_per_asset", lambda s, d: audit.check_one_per_group(adapter.memberships(s, d), ["ts_code"]), f"WITH {S} SELECT ts_code, count(*) AS n FROM memberships GROUP BY 1 HAVING count(*) <> 1")
register("collection_counts", lambda s, d: audit.collection_counts(_collections(s, d)), "SELECT event_type AS collection, count(*) AS n_rows FROM events GROUP BY 1")
register(
    "page_filter",
    lambda s, d: audit.page_filter(forecast_table(s, d), "1997-01-01", "1998-06-30", status="matured", ts_code=["S1", "S4", "S9"]).select(*K, "id"),
    f"WITH {ROWS_SQL} SELECT ts_code, trade_date, id FROM forecast_rows WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND status = 'matured' AND ts_code IN ('S1', 'S4', 'S9')",
)
register(
    "latest_per_group",
    lambda s, d: audit.latest_per_group(forecast_table(s, d).filter("status = 'matured'").select(*K, "id"), "trade_date", ["ts_code"]),
    f"WITH {ROWS_SQL} SELECT ts_code, max(trade_date) AS trade_date, arg_max(id, trade_date) AS id FROM forecast_rows WHERE status = 'matured' GROUP BY 1",
)


def _events(s: SparkSession, d: str) -> DataFrame:
    return grid_of(s, d).filter("vol > 180").select("trade_date", "ts_code")


register(
    "risk_event_filter",
    lambda s, d: audit.risk_event_filter(sessions(s, d).withColumn("flagged", F.col("session_index") % 25 == 3), _events(s, d)),
    f"WITH {P} SELECT trade_date, session_index, session_index % 25 = 3 AS flagged FROM calendar WHERE session_index % 25 = 3 OR trade_date IN (SELECT trade_date FROM grid WHERE vol > 180)",
)
register(
    "order_limit_offset",
    lambda s, d: audit.order_limit_offset(forecast_table(s, d).select(*K, "status"), [F.desc("trade_date"), F.col("ts_code")], 25, 40),
    f"WITH {ROWS_SQL} SELECT *, (SELECT count(*) FROM forecast_rows) AS total FROM (SELECT ts_code, trade_date, status FROM forecast_rows ORDER BY trade_date DESC, ts_code LIMIT 25 OFFSET 40)",
)
register(
    "attach_related",
    lambda s, d: audit.attach_related(forecast_table(s, d).select(*K, "status"), adapter.securities(s, d).select("ts_code", "exchange"), _events(s, d)),
    f"WITH {ROWS_SQL}, {S} SELECT r.ts_code, r.trade_date, status, exchange, coalesce(n, 0) AS n_events FROM forecast_rows r LEFT JOIN securities USING (ts_code) LEFT JOIN (SELECT trade_date, count(*) AS n FROM grid WHERE vol > 180 GROUP BY 1) e ON e.trade_date = r.trade_date",
)
register(
    "downsample_series",
    lambda s, d: audit.downsample_series(sessions(s, d), 12),
    f"WITH {P} SELECT trade_date, session_index FROM (SELECT *, count(*) OVER () AS n FROM calendar) WHERE session_index IN (SELECT floor(j * (n - 1) / 11.0 + 0.5) FROM range(12) r(j))",
)


def _states(s: SparkSession, d: str) -> DataFrame:
    return grid_of(s, d).select(*K, F.when(F.col("session_index") % 2 == 0, "growth").otherwise("share").alias("state"), F.when(F.col("vol") > 60, F.col("vol")).alias("value"))


register(
    "state_event_filter",
    lambda s, d: audit.state_event_filter(_states(s, d), ["growth"], ["S2", "S3"], False),
    f"WITH {P} SELECT ts_code, trade_date, 'growth' AS state, CASE WHEN vol > 60 THEN vol END AS value FROM grid WHERE session_index % 2 = 0 AND ts_code IN ('S2', 'S3') AND NOT coalesce(vol > 60, false)",
)
register(
    "catalog_search",
    lambda s, d: audit.catalog_search(adapter.securities(s, d).select(F.concat_ws("/", "area", "ts_code").alias("name"), "list_status"), "_1/s", "name", 20, list_status="L"),
    f"WITH {S} SELECT area || '/' || ts_code AS name, list_status FROM securities WHERE list_status = 'L' AND contains(lower(area || '/' || ts_code), '_1/s') ORDER BY name LIMIT 20",
)


def _runs(s: SparkSession, d: str) -> DataFrame:
    made = adapter.securities(s, d).join(adapter.panel(s, d), "ts_code").groupBy(F.col("exchange").alias("run_id"))
    return made.agg(F.avg("vol").alias("mean_vol"), F.count("*").cast("double").alias("n"), F.min("list_status").alias("data_hash"), F.max("industry").alias("target"), F.min("industry").alias("universe"))


register(
    "compare_runs",
    lambda s, d: audit.compare_runs(_runs(s, d), ["mean_vol", "n"]).withColumn("mean_vol_change", rounded("mean_vol_change")),
    f"""WITH {P}, {S}, r AS (SELECT exchange AS run_id, avg(vol) AS mean_vol, count(*)::DOUBLE AS n, min(list_status) AS data_hash, max(industry) AS target, min(industry) AS universe FROM securities JOIN panel USING (ts_code) GROUP BY 1), b AS (SELECT * FROM r ORDER BY run_id LIMIT 1)
    SELECT r.run_id, {rounded_sql('r.mean_vol - b.mean_vol')} AS mean_vol_change, r.n - b.n AS n_change, r.data_hash IS NOT DISTINCT FROM b.data_hash AS same_data_hash, r.target IS NOT DISTINCT FROM b.target AS same_target, r.universe IS NOT DISTINCT FROM b.universe AS same_universe FROM r, b""",
)
