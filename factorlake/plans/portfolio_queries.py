"""Queries of portfolio tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import portfolio
from ..sources import adapter
from .factor_queries import grid_of
from .label_queries import sessions
from .registry import register, rounded, rounded_sql
from .source_queries import number, round_sql, select_round

P = adapter.PANEL_SQL
K = ("ts_code", "trade_date")
W = "(PARTITION BY ts_code ORDER BY trade_date)"


def _top(s: SparkSession, d: str) -> DataFrame:
    return portfolio.top_n_weights(grid_of(s, d).withColumn("score", F.col("vol")), 3, 0.3, 2)


_TOP = f"{P}, top AS (SELECT trade_date, ts_code, place, 0.3::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY vol DESC, ts_code) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM grid WHERE vol IS NOT NULL AND session_index % 2 = 0) WHERE place <= 3 AND n >= 3)"
register("top_n_weights", _top, f"WITH {_TOP} SELECT * FROM top")
register(
    "trade_cost",
    lambda s, d: adapter.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(portfolio.trade_cost(F.col("l_extendedprice"), F.col("l_returnflag") == "R", 2.5, 5.0, 1.0, 10.0, 0.2), 4).alias("cost")),
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rounded_sql('''CASE WHEN l_extendedprice > 1e-10 THEN greatest(l_extendedprice * 2.5 / 1e4, 5.0) + l_extendedprice * 1.0 / 1e4 + CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 10.0 / 1e4 ELSE 0.0 END + l_extendedprice * 0.2 / 1e4 ELSE 0.0 END''', 4)} AS cost FROM lineitem",
)
_DAILY = f"""{_TOP}, moved AS (SELECT ts_code, trade_date, lead(open, 2) OVER {W} / lead(open, 1) OVER {W} - 1 AS r FROM grid), held AS (SELECT m.*, coalesce(weight, 0) AS weight FROM moved m LEFT JOIN top t ON t.ts_code = m.ts_code AND t.trade_date = m.trade_date),
turned AS (SELECT *, abs(weight - coalesce(lag(weight) OVER {W}, 0)) AS turn FROM held), daily AS (SELECT trade_date, sum(weight * coalesce(r, 0)) AS gross_return, sum(turn) AS turnover, sum(weight * coalesce(r, 0)) - sum(turn) * 10 / 1e4 AS net_return FROM turned GROUP BY 1)"""
_DV = ("gross_return", "turnover", "net_return")
register("weights_to_returns", lambda s, d: select_round(portfolio.weights_to_returns(grid_of(s, d), _top(s, d)), ("trade_date",), _DV), f"WITH {_DAILY} SELECT trade_date, {round_sql(_DV)} FROM daily")


def _tamed(s: SparkSession, d: str) -> DataFrame:
    daily = portfolio.weights_to_returns(grid_of(s, d), _top(s, d))
    return daily.withColumn("net_return", F.least(F.greatest("net_return", F.lit(-0.5)), F.lit(0.5)) / 10)


_EM = ("total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "turnover")
register(
    "equity_metrics",
    lambda s, d: select_round(portfolio.equity_metrics(_tamed(s, d)), (), _EM, 4),
    f"""WITH {_DAILY}, x AS (SELECT trade_date, turnover, least(greatest(net_return, -0.5), 0.5) / 10 AS r FROM daily), n AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY trade_date)) AS nav FROM x), q AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY trade_date), 1.0) - 1 AS fall FROM n),
    t AS (SELECT exp(sum(ln(1 + r))) - 1 AS total_return, pow(exp(sum(ln(1 + r))), 252.0 / count(r)) - 1 AS annual_return, stddev_samp(r) * sqrt(252.0) AS volatility, avg(r) / stddev_samp(r) * sqrt(252.0) AS sharpe, min(fall) AS max_drawdown, sum(turnover) AS turnover FROM q) SELECT {round_sql(_EM, 4)} FROM t""",
)
register(
    "borrow_cost",
    lambda s, d: adapter.table(s, d, "customer").select("c_custkey", rounded(portfolio.borrow_cost(F.col("c_acctbal"), 300.0)).alias("cost")),
    f"SELECT c_custkey, {rounded_sql('greatest(-c_acctbal, 0.0) * 300.0 / 1e4 / 252')} AS cost FROM customer",
)


register(
    "factor_exposure",
    lambda s, d: select_round(portfolio.factor_exposure(portfolio.mark_last_close(grid_of(s, d)), _top(s, d), "mark"), ("trade_date", "n"), ("exposure",)),
    f"""WITH {_TOP}, m AS (SELECT ts_code, trade_date, last_value(close IGNORE NULLS) OVER {W} AS mark FROM grid), z AS (SELECT ts_code, trade_date, CASE WHEN count(mark) OVER q = count(*) OVER q AND stddev_pop(mark) OVER q > 1e-12 THEN (mark - avg(mark) OVER q) / stddev_pop(mark) OVER q END AS z FROM m WINDOW q AS (PARTITION BY trade_date)), l AS (SELECT ts_code, trade_date, lag(z) OVER {W} AS z FROM z),
    t AS (SELECT trade_date, CASE WHEN count(z) = count(*) THEN sum(weight * z) END AS exposure, count(z) AS n FROM top JOIN l USING (ts_code, trade_date) GROUP BY 1) SELECT trade_date, n, {rounded_sql('exposure')} AS exposure FROM t""",
)


_RB = ("gross", "net", "largest")
register(
    "risk_breaches",
    lambda s, d: select_round(portfolio.risk_breaches(grid_of(s, d).filter("vol IS NOT NULL").select(*K, ((F.col("vol") - 90) / 1000).alias("weight")), 0.5, 0.2, 0.1), ("trade_date", "gross_breach", "net_breach", "single_breach"), _RB),
    f"""WITH {P}, t AS (SELECT trade_date, sum(abs((vol - 90) / 1000)) AS gross, sum((vol - 90) / 1000) AS net, max(abs((vol - 90) / 1000)) AS largest FROM grid WHERE vol IS NOT NULL GROUP BY 1), u AS (SELECT *, gross > 0.5 AS gross_breach, abs(net) > 0.2 AS net_breach, largest > 0.1 AS single_breach FROM t)
    SELECT trade_date, gross_breach, net_breach, single_breach, {round_sql(_RB)} FROM u WHERE gross_breach OR net_breach OR single_breach""",
)
register(
    "buy_and_hold_benchmark",
    lambda s, d: select_round(portfolio.buy_and_hold_benchmark(grid_of(s, d), 100.0), ("trade_date",), ("benchmark",)),
    f"""WITH {P}, f AS (SELECT ts_code, close AS start FROM grid WHERE trade_date = (SELECT min(trade_date) FROM grid) AND close IS NOT NULL AND vol > 0), m AS (SELECT ts_code, trade_date, last_value(close IGNORE NULLS) OVER {W} AS mark FROM grid), n AS (SELECT count(DISTINCT ts_code) AS n FROM grid),
    t AS (SELECT trade_date, sum(CASE WHEN start IS NULL THEN 100.0 / n ELSE 100.0 / n * mark / start END) AS benchmark FROM m LEFT JOIN f USING (ts_code), n GROUP BY 1) SELECT trade_date, {rounded_sql('benchmark')} AS benchmark FROM t""",
)
register(
    "mark_last_close",
    lambda s, d: select_round(portfolio.mark_last_close(grid_of(s, d)), (*K, "stale"), ("mark",)),
    f"WITH {P}, m AS (SELECT ts_code, trade_date, close, last_value(close IGNORE NULLS) OVER {W} AS mark FROM grid) SELECT ts_code, trade_date, close IS NULL AND mark IS NOT NULL AS stale, {rounded_sql('mark')} AS mark FROM m",
)
_EX = ("gross", "net", "long", "short")
register(
    "exposure_series",
    lambda s, d: select_round(portfolio.exposure_series(grid_of(s, d).filter("close IS NOT NULL").select("trade_date", ((F.col("vol") - 90) * F.col("close")).alias("value"), F.lit(1e6).alias("nav"))), ("trade_date",), _EX),
    f"WITH {P}, v AS (SELECT trade_date, (vol - 90) * close AS value FROM grid WHERE close IS NOT NULL), t AS (SELECT trade_date, sum(abs(value)) / 1e6 AS gross, sum(value) / 1e6 AS net, sum(greatest(value, 0.0)) / 1e6 AS long, sum(least(value, 0.0)) / 1e6 AS short FROM v GROUP BY 1) SELECT trade_date, {round_sql(_EX)} FROM t",
)
register(
    "tradable_flag",
    lambda s, d: portfolio.tradable_flag(grid_of(s, d)).select(*K, "can_buy", "can_sell"),
    f"WITH {P}, t AS (SELECT *, lag(close) OVER {W} AS before FROM grid) SELECT ts_code, trade_date, coalesce(open > 0 AND vol > 0 AND NOT coalesce(high = low AND open > before, false), false) AS can_buy, coalesce(open > 0 AND vol > 0 AND NOT coalesce(high = low AND open < before, false), false) AS can_sell FROM t",
)
