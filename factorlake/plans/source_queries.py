"""Queries of loading, data quality, calendars and shared series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import context, grid
from ..sources import adapter, quality
from ..sources.shared import shared_folder
from .factor_queries import grid_of
from .registry import register, rounded, rounded_sql

P = adapter.PANEL_SQL


def number():
    return F.substring("ts_code", 2, 12).cast("long")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with faults planted by symbol and session."""
    bars = adapter.panel(spark, sf_dir)
    rows = bars.join(F.broadcast(adapter.calendar(bars)), "trade_date").withColumn("k", F.col("session_index") + number() * 7)
    return rows.withColumns({
        "close": F.when(F.col("k") % 17 == 3, -F.col("close")).otherwise(F.col("close")), "high": F.when(F.col("k") % 19 == 4, F.col("low") * 0.5).otherwise(F.col("high")),
        "vol": F.when(F.col("k") % 23 == 5, F.lit(-1.0)).otherwise(F.col("vol")), "amount": F.when(F.col("k") % 29 == 6, F.lit(None).cast("double")).otherwise(F.col("amount")),
    })


DIRTY = f"""{P}, dirty AS (SELECT * REPLACE (CASE WHEN k % 17 = 3 THEN -close ELSE close END AS close, CASE WHEN k % 19 = 4 THEN low * 0.5 ELSE high END AS high,
  CASE WHEN k % 23 = 5 THEN -1.0 ELSE vol END AS vol, CASE WHEN k % 29 = 6 THEN NULL ELSE amount END AS amount)
  FROM (SELECT p.*, session_index, session_index + substr(ts_code, 2)::BIGINT * 7 AS k FROM panel p JOIN calendar USING (trade_date)))"""
_KEYS = ("ts_code", "trade_date")
_OHLC = ("open", "high", "low", "close")


def select_round(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in values])


def round_sql(values: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"{rounded_sql(c, digits)} AS {c}" for c in values)


_ALL = (*_OHLC, "raw_close", "vol", "amount", "adj_factor")
register("read_panel", lambda s, d: select_round(quality.keep_columns(dirty(s, d)), _KEYS, _ALL), f"WITH {DIRTY} SELECT ts_code, trade_date, {round_sql(_ALL)} FROM dirty")


def _loose(s: SparkSession, d: str) -> DataFrame:
    return adapter.table(s, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ts_code"), F.to_date("l_shipdate").alias("trade_date"))


register("check_keys_unique", lambda s, d: quality.check_keys_unique(_loose(s, d)), "SELECT 'S' || l_suppkey AS ts_code, l_shipdate::DATE AS trade_date, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
register(
    "check_universe_dates",
    lambda s, d: quality.check_universe_dates(adapter.panel(s, d), adapter.symbols(s, d).filter(number() % 5 != 0), "1996-01-01", "2000-12-31").select(*_KEYS, "reason"),
    f"""WITH {P} SELECT ts_code, trade_date, CASE WHEN substr(ts_code, 2)::BIGINT % 5 = 0 THEN 'universe' ELSE 'dates' END AS reason FROM panel
    WHERE substr(ts_code, 2)::BIGINT % 5 = 0 OR trade_date < DATE '1996-01-01' OR trade_date > DATE '2000-12-31'""",
)
register(
    "check_prices",
    lambda s, d: quality.check_prices(dirty(s, d)).select(*_KEYS, "bad_fields"),
    f"""WITH {DIRTY}, marked AS (SELECT ts_code, trade_date, concat_ws(',', CASE WHEN NOT close > 0 THEN 'close' END, CASE WHEN NOT vol >= 0 THEN 'vol' END,
    CASE WHEN amount IS NULL OR amount < 0 THEN 'amount' END) AS bad_fields FROM dirty) SELECT * FROM marked WHERE bad_fields <> ''""",
)
register(
    "check_ohlc_envelope",
    lambda s, d: quality.check_ohlc_envelope(dirty(s, d)).select(*_KEYS),
    f"WITH {DIRTY} SELECT ts_code, trade_date FROM dirty WHERE low > least(open, close) + high * 1e-8 OR high < greatest(open, close) - high * 1e-8",
)


def _typed(s: SparkSession, d: str) -> DataFrame:
    events = adapter.table(s, d, "events")
    core = F.when(F.col("event_id") % 11 == 0, "true").when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    external = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).when(F.col("event_id") % 17 == 0, "false").otherwise(F.col("user_id").cast("string"))
    return events.select("event_id", core.alias("core"), external.alias("external"))


register(
    "check_numeric_type",
    lambda s, d: quality.check_numeric_type(_typed(s, d), ["core"], ["external"]).select("event_id", "bad_fields"),
    """WITH marked AS (SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'core' END, CASE WHEN event_id % 7 = 0 OR event_id % 17 = 0 THEN 'external' END) AS bad_fields FROM events WHERE user_id IS NOT NULL)
    SELECT * FROM marked WHERE bad_fields <> ''""",
)


def _dated(s: SparkSession, d: str) -> DataFrame:
    return adapter.panel(s, d).withColumns({"fd_x": F.when(number() % 3 != 0, F.col("vol")), "fd_x__available_date": F.when(number() % 4 != 0, F.date_add("trade_date", (number() % 5 - 3).cast("int")))})


register(
    "check_point_in_time",
    lambda s, d: quality.check_point_in_time(_dated(s, d), ["fd_x"]).select(*_KEYS, "bad_fields"),
    f"WITH {P} SELECT ts_code, trade_date, 'fd_x' AS bad_fields FROM (SELECT *, substr(ts_code, 2)::BIGINT AS n FROM panel) WHERE n % 3 <> 0 AND (n % 4 = 0 OR n % 5 - 3 > 0)",
)
register(
    "derive_amount",
    lambda s, d: quality.derive_amount(dirty(s, d)).select(*_KEYS, "derived", rounded("amount", 4).alias("amount")),
    f"WITH {DIRTY}, t AS (SELECT *, amount IS NULL AND abs(close - raw_close) <= 1e-9 * greatest(abs(close), abs(raw_close)) AS derived FROM dirty) SELECT ts_code, trade_date, derived, {rounded_sql('CASE WHEN derived THEN vol * close * 100 / 1000 ELSE amount END', 4)} AS amount FROM t",
)
register(
    "default_raw_columns",
    lambda s, d: select_round(quality.default_raw_columns(adapter.panel(s, d).drop("raw_close").withColumn("adj_factor", F.when(number() % 2 == 0, 1.5))), _KEYS, ("raw_close", "adj_factor")),
    f"WITH {P} SELECT ts_code, trade_date, {rounded_sql('close')} AS raw_close, CASE WHEN substr(ts_code, 2)::BIGINT % 2 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS adj_factor FROM panel",
)
register(
    "normalize_signed_zero",
    lambda s, d: quality.normalize_signed_zero(adapter.panel(s, d).withColumn("zero", F.when(number() % 2 == 0, F.lit(-0.0)).otherwise(F.col("vol"))), ["zero"]).select(*_KEYS, "zero", F.hex(F.col("zero").cast("string")).alias("written")),
    f"WITH {P}, t AS (SELECT ts_code, trade_date, CASE WHEN substr(ts_code, 2)::BIGINT % 2 = 0 THEN 0.0 ELSE vol END::DOUBLE AS zero FROM panel) SELECT *, hex(zero::VARCHAR) AS written FROM t",
)


def _factors(s: SparkSession, d: str) -> DataFrame:
    """Adjustment factors that grow with the sessions; each symbol lacks one session in 31."""
    bars = adapter.panel(s, d)
    rows = bars.join(F.broadcast(adapter.calendar(bars)), "trade_date")
    return rows.filter((F.col("session_index") + number()) % 31 != 0).select(*_KEYS, (1 + F.floor(F.col("session_index") / 20) * 0.125).alias("adj_factor"))


_ADJ = f"{P}, adj AS (SELECT ts_code, trade_date, 1 + floor(session_index / 20) * 0.125 AS adj_factor FROM panel JOIN calendar USING (trade_date) WHERE (session_index + substr(ts_code, 2)::BIGINT) % 31 <> 0)"
register(
    "adjust_prices",
    lambda s, d: select_round(quality.adjust_prices(adapter.panel(s, d), _factors(s, d)), _KEYS, (*_OHLC, "raw_close")),
    f"""WITH {_ADJ}, t AS (SELECT p.* EXCLUDE (adj_factor), a.adj_factor / first_value(a.adj_factor IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m
    FROM panel p LEFT JOIN adj a USING (ts_code, trade_date)) SELECT ts_code, trade_date, {', '.join(f"{rounded_sql(f'{c} * m')} AS {c}" for c in _OHLC)}, {rounded_sql('close')} AS raw_close FROM t""",
)
register("require_adjustment", lambda s, d: quality.require_adjustment(adapter.panel(s, d), _factors(s, d)).select(*_KEYS), f"WITH {_ADJ} SELECT ts_code, trade_date FROM panel ANTI JOIN adj USING (ts_code, trade_date)")
register(
    "join_daily_basic",
    lambda s, d: quality.join_daily_basic(adapter.panel(s, d).select(*_KEYS, "close"), _factors(s, d).withColumnRenamed("adj_factor", "pe")).select(*_KEYS, rounded("close").alias("close"), "pe"),
    f"WITH {_ADJ} SELECT ts_code, trade_date, {rounded_sql('close')} AS close, a.adj_factor AS pe FROM panel p LEFT JOIN adj a USING (ts_code, trade_date)",
)


def _days(s: SparkSession, d: str) -> DataFrame:
    """Civil days of orders; weekdays are open. Every 41st is missing, every 43rd twice."""
    day = F.to_date("o_orderdate")
    days = adapter.table(s, d, "orders").select(day.alias("cal_date")).distinct()
    k = F.datediff("cal_date", F.lit("1992-01-01").cast("date"))
    days = days.filter(k % 41 != 0).withColumn("n", F.when(k % 43 == 0, 2).otherwise(1))
    rows = days.withColumn("n", F.explode(F.sequence(F.lit(1), "n")))
    return rows.select("cal_date", F.when(F.weekday("cal_date") < 5, 1).otherwise(0).alias("is_open"), F.date_sub("cal_date", F.pmod(k, F.lit(37)).cast("int")).alias("pretrade_date"))


_DAYS = """days0 AS (SELECT DISTINCT o_orderdate::DATE AS cal_date FROM orders), days AS (
  SELECT cal_date, CASE WHEN isodow(cal_date) < 6 THEN 1 ELSE 0 END AS is_open, cal_date - ((cal_date - DATE '1992-01-01') % 37)::INT AS pretrade_date
  FROM (SELECT cal_date, unnest(range(1, CASE WHEN (cal_date - DATE '1992-01-01') % 43 = 0 THEN 3 ELSE 2 END)) FROM days0 WHERE (cal_date - DATE '1992-01-01') % 41 <> 0))"""
register(
    "calendar_from_flags",
    lambda s, d: quality.calendar_from_flags(_days(s, d)),
    f"""WITH {_DAYS}, span AS (SELECT unnest(generate_series(min(cal_date), max(cal_date), INTERVAL 1 DAY))::DATE AS cal_date FROM days), seen AS (SELECT cal_date, count(*) AS n, max(is_open) AS is_open FROM days GROUP BY 1)
    SELECT * FROM (SELECT cal_date AS trade_date, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem, is_open FROM span LEFT JOIN seen USING (cal_date)) WHERE is_open = 1 OR problem IS NOT NULL""".replace(
        "SELECT * FROM (SELECT cal_date", "SELECT trade_date, problem FROM (SELECT cal_date"
    ),
)
register("calendar_previous_check", lambda s, d: quality.calendar_previous_check(_days(s, d)), f"WITH {_DAYS} SELECT * FROM days WHERE pretrade_date >= cal_date")


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = adapter.panel(s, d)
    return bars.filter("vol > 280"), bars.filter("vol < 2")


register(
    "calendars_agree",
    lambda s, d: quality.calendars_agree(*_two(s, d)),
    f"""WITH {P}, a AS (SELECT DISTINCT trade_date FROM panel WHERE vol > 280), b AS (SELECT DISTINCT trade_date FROM panel WHERE vol < 2)
    SELECT trade_date, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT trade_date, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
register(
    "rows_in_calendar",
    lambda s, d: quality.rows_in_calendar(adapter.panel(s, d), adapter.calendar(adapter.panel(s, d)).filter("session_index % 9 <> 4")).select(*_KEYS),
    f"WITH {P} SELECT ts_code, trade_date FROM panel JOIN calendar USING (trade_date) WHERE session_index % 9 = 4",
)
register("complete_grid", lambda s, d: select_round(grid_of(s, d), (*_KEYS, "session_index"), _ALL), f"WITH {P} SELECT ts_code, trade_date, session_index, {round_sql(_ALL)} FROM grid")
register("grid_coverage", lambda s, d: grid.coverage(grid_of(s, d)), f"WITH {P} SELECT ts_code, count(close) AS observed_rows, count(*) AS expected_rows, count(*) - count(close) AS missing_rows FROM grid GROUP BY 1")
register(
    "field_coverage",
    lambda s, d: grid.field_coverage(dirty(s, d), ["close", "amount"]).select("field", rounded("coverage").alias("coverage")),
    f"WITH {DIRTY}, t AS (SELECT 'close' AS field, count(close) / count(*) AS coverage FROM dirty UNION ALL SELECT 'amount', count(amount) / count(*) FROM dirty) SELECT field, {rounded_sql('coverage')} AS coverage FROM t",
)
register("table_fingerprint", lambda s, d: quality.table_fingerprint(adapter.panel(s, d), [*_KEYS, *_ALL]))
register(
    "scope_view",
    lambda s, d: select_round(quality.scope_view(adapter.panel(s, d), adapter.symbols(s, d).filter(number() % 3 == 0), "1996-06-01", "1998-06-01"), _KEYS, ("close",)),
    f"WITH {P} SELECT ts_code, trade_date, {rounded_sql('close')} AS close FROM panel WHERE substr(ts_code, 2)::BIGINT % 3 = 0 AND trade_date BETWEEN DATE '1996-06-01' AND DATE '1998-06-01'",
)
register(
    "scope_violations",
    lambda s, d: quality.scope_violations(adapter.panel(s, d), adapter.memberships(s, d)),
    f"WITH {P}, {adapter.SECURITIES_SQL} SELECT DISTINCT ts_code FROM memberships WHERE ts_code NOT IN (SELECT ts_code FROM panel)",
)


def _states(s: SparkSession, d: str) -> DataFrame:
    bars = adapter.panel(s, d)
    a = bars.filter(number() % 4 != 0).select(*_KEYS, F.lit("growth").alias("state"), F.col("vol").alias("value"))
    b = bars.select(*_KEYS, F.lit("share").alias("state"), (F.col("vol") + 1).alias("value"))
    return a.union(b).union(b.filter(number() % 6 == 0))


_STATES = f"""{P}, states AS (SELECT ts_code, trade_date, 'growth' AS state, vol AS value FROM panel WHERE substr(ts_code, 2)::BIGINT % 4 <> 0 UNION ALL SELECT ts_code, trade_date, 'share', vol + 1 FROM panel
  UNION ALL SELECT ts_code, trade_date, 'share', vol + 1 FROM panel WHERE substr(ts_code, 2)::BIGINT % 6 = 0)"""
register(
    "compose_states",
    lambda s, d: quality.compose_states(adapter.panel(s, d).select(*_KEYS), _states(s, d).distinct(), ["growth", "share"]),
    f"""WITH {_STATES} SELECT ts_code, trade_date, CASE WHEN count(*) FILTER (state = 'growth') = 1 THEN max(value) FILTER (state = 'growth') END AS growth, CASE WHEN count(*) FILTER (state = 'share') = 1 THEN max(value) FILTER (state = 'share') END AS share
    FROM panel JOIN (SELECT DISTINCT * FROM states) USING (ts_code, trade_date) GROUP BY ALL""",
)
register("claimed_twice", lambda s, d: quality.claimed_twice(_states(s, d)), f"WITH {_STATES} SELECT ts_code, trade_date, state, count(*) AS n_rows FROM states GROUP BY ALL HAVING count(*) > 1")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    rows = adapter.reports(s, d)
    return rows.withColumns({"revenue": F.when(number() % 5 == 1, F.lit("n/a")).otherwise(F.floor("revenue").cast("string")), "ann_date": F.when(number() % 7 == 2, F.date_sub("end_date", 3)).otherwise(F.col("ann_date"))}).drop("cost")


register(
    "normalize_statements",
    lambda s, d: quality.normalize_statements(_snapshots(s, d), adapter.symbols(s, d).filter(number() % 11 != 0), ["revenue"]),
    f"""WITH {adapter.REPORTS_SQL}, t AS (SELECT ts_code, substr(ts_code, 2)::BIGINT AS n, end_date, CASE WHEN n % 7 = 2 THEN end_date - 3 ELSE ann_date END AS ann_date, revenue FROM reports)
    SELECT ts_code, end_date, ann_date, CASE WHEN n % 5 <> 1 THEN floor(revenue) END AS revenue,
    concat_ws(',', CASE WHEN n % 11 = 0 THEN 'symbol' END, CASE WHEN n % 7 = 2 THEN 'dates' END, CASE WHEN n % 5 = 1 THEN 'revenue' END) AS reasons FROM t""",
)


def _collections(s: SparkSession, d: str) -> DataFrame:
    bars = adapter.panel(s, d)
    made = {"calendar": adapter.calendar(bars), "panel": bars, "reports": adapter.reports(s, d)}
    return quality.write_collections(made, f"{shared_folder(s)}/collections-{uuid.uuid4().hex}", partition="end_date")


register(
    "write_collections",
    _collections,
    f"""WITH {P}, {adapter.REPORTS_SQL} SELECT 'calendar' AS collection, count(*) AS n_rows, 'session_index,trade_date' AS columns FROM calendar
    UNION ALL SELECT 'panel', count(*), 'adj_factor,amount,close,high,low,open,raw_close,trade_date,ts_code,vol' FROM panel UNION ALL SELECT 'reports', count(*), 'ann_date,cost,end_date,revenue,ts_code' FROM reports""",
)
register("synthetic_panel", lambda s, d: quality.synthetic_panel(adapter.calendar(adapter.panel(s, d)), adapter.symbols(s, d)))

C = adapter.CONTEXT_SQL
register(
    "context_broadcast_by_date",
    lambda s, d: context.broadcast_by_date(grid_of(s, d).select(*_KEYS), adapter.context(s, d), {"close": "ext_ctx_close"}),
    f"WITH {P}, {C} SELECT ts_code, g.trade_date, c.close AS ext_ctx_close FROM grid g LEFT JOIN context c ON g.trade_date = c.trade_date",
)
register(
    "context_asof_strict_prior",
    lambda s, d: context.asof_strict_prior(adapter.calendar(adapter.panel(s, d)), adapter.context(s, d), ["close", "vol"]),
    f"""WITH {P}, {C}, t AS (SELECT k.trade_date, arg_max(c, c.trade_date) AS r FROM calendar k LEFT JOIN context c ON c.trade_date < k.trade_date GROUP BY 1)
    SELECT trade_date, CASE WHEN trade_date - r.trade_date <= 7 THEN r.trade_date END AS source_date, CASE WHEN trade_date - r.trade_date <= 7 THEN r.close END AS close, CASE WHEN trade_date - r.trade_date <= 7 THEN r.vol END AS vol FROM t""",
)
register("context_available_date", lambda s, d: context.foreign_available_date(adapter.context(s, d)), f"WITH {C} SELECT trade_date, close, vol, trade_date + 1 AS available_date FROM context")
register(
    "context_adjusted_close",
    lambda s, d: context.adjusted_close(adapter.context(s, d).withColumn("adj_factor", F.col("vol") % 3)).select("trade_date", rounded("adjusted_close").alias("adjusted_close")),
    f"WITH {C}, t AS (SELECT trade_date, close * (vol % 3) AS v FROM context) SELECT trade_date, {rounded_sql('CASE WHEN v > 0 THEN v END')} AS adjusted_close FROM t",
)
_NATIVE = {"m4": f.returns(f.field("close"), 4), "v4": f.ts_mean(f.field("vol"), 4)}
register(
    "context_native_clock_factor",
    lambda s, d: select_round(context.native_clock_factor(adapter.calendar(adapter.panel(s, d)), adapter.context(s, d), _NATIVE), ("trade_date",), tuple(_NATIVE)),
    f"""WITH {P}, {C}, o AS (SELECT *, 'c' AS ts_code FROM context), {f.factor_sql(_NATIVE, 'o', 'own', mask=False)}, t AS (SELECT k.trade_date, arg_max(c, c.trade_date) AS r FROM calendar k LEFT JOIN own c ON c.trade_date < k.trade_date GROUP BY 1)
    SELECT trade_date, {rounded_sql('CASE WHEN trade_date - r.trade_date <= 7 THEN r.m4 END')} AS m4, {rounded_sql('CASE WHEN trade_date - r.trade_date <= 7 THEN r.v4 END')} AS v4 FROM t""",
)
register(
    "check_global_constant",
    lambda s, d: context.check_global_constant(adapter.panel(s, d).withColumn("shared", F.floor("vol") % 3), ["shared", "adj_factor"]),
    f"WITH {P} SELECT trade_date, 'shared' AS field, count(DISTINCT floor(vol) % 3) AS n_values FROM panel GROUP BY 1 HAVING count(DISTINCT floor(vol) % 3) > 1",
)
register(
    "global_restore",
    lambda s, d: select_round(context.global_restore(context.broadcast_by_date(grid_of(s, d), adapter.context(s, d), {"close": "g"}).withColumn("g", F.when(F.col("close").isNotNull(), F.col("g"))), "g"), _KEYS, ("g",)),
    f"""WITH {P}, {C}, t AS (SELECT ts_code, g.trade_date, CASE WHEN g.close IS NOT NULL THEN c.close END AS g FROM grid g LEFT JOIN context c ON g.trade_date = c.trade_date)
    SELECT ts_code, trade_date, {rounded_sql('coalesce(g, max(g) OVER (PARTITION BY trade_date))')} AS g FROM t""",
)
