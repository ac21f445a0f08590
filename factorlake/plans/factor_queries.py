"""Queries of factor columns, recipes and transforms over the complete grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..functions import recipes, transforms
from ..operators.grid import complete_grid
from ..sources import adapter
from .registry import register, rounded, rounded_sql


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = adapter.panel(spark, sf_dir)
    return complete_grid(bars, adapter.calendar(bars), adapter.symbols(spark, sf_dir))


def with_basics(grid: DataFrame) -> DataFrame:
    """Daily valuation fields, derived from prices and volumes so that each cell has them."""
    made = {
        "pe": "close / 100 - 5", "pe_ttm": "open / 100 - 5", "pb": "high / 500", "ps": "low / 300", "ps_ttm": "low / 280 - 1", "dv_ratio": "vol / 10", "dv_ttm": "vol / 12", "total_mv": "close * vol", "circ_mv": "close * (vol - 1)",
        "turnover_rate": "vol / 50", "turnover_rate_f": "vol / 40", "volume_ratio": "amount / 50000", "float_share": "vol", "free_share": "vol * 0.7", "total_share": "vol + 10",
    }
    return grid.withColumns({name: F.expr(x).cast("double") for name, x in made.items()})


BASICS_SQL = """
basics AS (SELECT *, close / 100 - 5 AS pe, open / 100 - 5 AS pe_ttm, high / 500 AS pb, low / 300 AS ps, low / 280 - 1 AS ps_ttm, vol / 10 AS dv_ratio, vol / 12 AS dv_ttm, close * vol AS total_mv, close * (vol - 1) AS circ_mv,
  vol / 50 AS turnover_rate, vol / 40 AS turnover_rate_f, amount / 50000 AS volume_ratio, vol AS float_share, vol * 0.7::DOUBLE AS free_share, vol + 10 AS total_share FROM grid)"""


def with_index(grid: DataFrame) -> DataFrame:
    """An index that all symbols share: the day's mean close and total amount."""
    days = grid.groupBy("trade_date").agg(F.round(F.avg("close"), 4).alias("ext_ctx_close"), F.round(F.sum("amount"), 2).alias("ext_ctx_amount"))
    return grid.join(F.broadcast(days), "trade_date")


INDEX_SQL = """
days AS (SELECT trade_date, round(avg(close), 4) AS ext_ctx_close, round(sum(amount), 2) AS ext_ctx_amount FROM grid GROUP BY trade_date),
indexed AS (SELECT * FROM grid JOIN days USING (trade_date))"""


def add(name: str, made: dict[str, f.Factor], digits: int = 6, base: str = "grid", prepare=None, sql: str = "", directions: dict[str, int] | None = None, mask: bool = True) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = grid_of(spark, sf_dir)
        out = f.evaluate(prepare(grid) if prepare else grid, made, directions, mask)
        return out.select("ts_code", "trade_date", *[rounded(c, digits).alias(c) for c in made])

    text = f"WITH {adapter.PANEL_SQL}{',' + sql if sql else ''},\n{f.factor_sql(made, base, mask=mask, directions=directions)}\nSELECT ts_code, trade_date, {', '.join(f'{rounded_sql(c, digits)} AS {c}' for c in made)} FROM factors"
    register(name, query, text)


x, vol, r = f.field("close"), f.field("vol"), f.returns(f.field("close"), 1)
for _name, _made in {
    "lag_n": {"lag3": f.lag(x, 3)},
    "returns": {"ret1": r, "ret5": f.returns(x, 5)},
    "delta": {"delta3": f.delta(x, 3)},
    "ts_mean": {"mean5": f.ts_mean(x, 5), "mean10": f.ts_mean(vol, 10)},
    "ts_std": {"std5": f.ts_std(x, 5)},
    "ts_min": {"min5": f.ts_min(x, 5)},
    "ts_max": {"max5": f.ts_max(x, 5)},
    "ts_sum": {"sum5": f.ts_sum(vol, 5)},
    "ts_rank": {"ts_rank5": f.ts_rank(vol, 5)},
    "rank": {"rank_close": f.rank(x), "rank_vol": f.rank(vol)},
    "zscore": {"zscore_close": f.zscore(x)},
    "log": {"log_ret": f.log(r), "log_close": f.log(x)},
    "sqrt": {"sqrt_ret": f.sqrt(r)},
    "abs": {"abs_ret": f.absolute(r)},
    "sign": {"sign_ret": f.sign(r)},
    "clip": {"clip_ret": f.clip(r, -0.1, 0.1)},
    "min2_max2": {"low_of": f.min2(x, f.lag(x, 1)), "high_of": f.max2(x, f.lag(x, 1))},
    "arithmetic": {"mixed": (x + 2 * f.field("open") - f.field("low")) * 0.5, "negated": -x, "plain": +x},
    "safe_div": {"quotient": x / (vol - 50), "inverse": 1 / (x - x)},
    "finite": {"finite_div": f.field("close") / 1e-300},
    "evaluate_factors": {"a": f.rank(f.ts_mean(f.zscore(f.returns(x, 3)), 3)), "b": f.ts_mean(f.rank(vol), 5), "c": f.zscore(f.ts_std(r, 5)) - f.rank(f.ts_mean(f.zscore(f.returns(x, 3)), 3))},
}.items():
    add(f"factor_{_name}", _made)
add("factor_mask_missing_close", {"masked": f.lag(x, 1)}, mask=True)
add("factor_unmasked", {"unmasked": f.lag(x, 1)}, mask=False)
add("factor_direction", {"down": f.returns(x, 5)}, directions={"down": -1})


# The oracles of recipes are written here from their definitions, not made from the factors. In them M, S, N, X and T are
# mean, population deviation, least, greatest and sum of the last n cells, none of them missing, and D divides.
def _over(f: str, x: str, n: int, last: int = 0) -> str:
    w = f"(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1 + last} PRECEDING AND {last} PRECEDING)"
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END)"


def _d(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END)"


_CELLS = """cells AS (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS c1 FROM {base}),
inputs AS (SELECT *, CASE WHEN abs(c1) > 1e-12 THEN close / c1 - 1 END AS r, close - c1 AS d, abs(close - c1) AS ad FROM cells),
made AS (SELECT *, r * vol AS rv, abs(r) AS ar, CASE WHEN r IS NOT NULL THEN least(r, 0.0) * least(r, 0.0) END AS r2, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, sign(CASE WHEN r IS NOT NULL THEN greatest(r, 0.0) END)::DOUBLE AS rose,
  CASE WHEN abs(close) > 1e-12 THEN (high - low) / close END AS span, CASE WHEN amount IS NOT NULL THEN abs(r) / greatest(amount, 1.0) END AS ill, CASE WHEN abs(c1) > 1e-12 THEN open / c1 - 1 END AS night, CASE WHEN abs(open) > 1e-12 THEN (close - open) / open END AS day,
  CASE WHEN abs(low) > 1e-12 AND high / low > 0 THEN ln(high / low) * ln(high / low) END AS hl2, CASE WHEN abs(high - low) > 1e-12 THEN (2 * close - high - low) / (high - low) * vol END AS flow FROM inputs)"""
_M, _S, _N, _X, _T = (lambda x, n, last=0, f=f: _over(f, x, n, last) for f in ("avg", "stddev_pop", "min", "max", "sum"))


def _back(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY ts_code ORDER BY trade_date)"


def _place(x: str, n: int) -> str:
    w = f"(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN (len(list_filter(list({x}) OVER {w}, lambda v: v < {x})) + (len(list_filter(list({x}) OVER {w}, lambda v: v = {x})) + 1) / 2.0) / {n} END)"


_RECIPE_SQL = {
    "momentum": (1, lambda n: f"{_d('close', _back('close', n))} - 1"),
    "reversal": (-1, lambda n: f"{_d('close', _back('close', n))} - 1"),
    "volatility": (-1, lambda n: _S("r", n)),
    "range": (-1, lambda n: _M("span", n)),
    "volume_surge": (1, lambda n: f"{_d('vol', _M('vol', n))} - 1"),
    "volume_variation": (-1, lambda n: _d(_S("vol", n), _M("vol", n))),
    "liquidity": (1, lambda n: f"(CASE WHEN {_M('amount', n)} > 0 THEN ln({_M('amount', n)}) END)"),
    "illiquidity": (-1, lambda n: _M("ill", n)),
    "trend_strength": (1, lambda n: f"{_d('close', _M('close', n))} - 1"),
    "range_position": (1, lambda n: _d(f"close - {_N('low', n)}", f"{_X('high', n)} - {_N('low', n)}")),
    "rsi_ratio": (1, lambda n: _d(_M("up", n), _M("ad", n))),
    "downside_risk": (-1, lambda n: f"sqrt({_M('r2', n)})"),
    "overnight_momentum": (1, lambda n: _M("night", n)),
    "intraday_momentum": (1, lambda n: _M("day", n)),
    "breakout": (1, lambda n: f"{_d('close', _X('high', n, 1))} - 1"),
    "drawdown": (1, lambda n: f"{_d('close', _X('close', n))} - 1"),
    "rebound": (-1, lambda n: f"{_d('close', _N('close', n))} - 1"),
    "trend_efficiency": (1, lambda n: _d(f"close - {_back('close', n)}", _T("ad", n))),
    "trend_persistence": (1, lambda n: _M("rose", n)),
    "mean_return": (1, lambda n: _M("r", n)),
    "historical_sharpe": (1, lambda n: _d(_M("r", n), _S("r", n))),
    "bollinger_position": (1, lambda n: _d(f"close - {_M('close', n)}", _S("close", n))),
    "parkinson_volatility": (-1, lambda n: f"sqrt({_M('hl2', n)} / (4 * ln(2.0)))"),
    "max_return": (-1, lambda n: _X("r", n)),
    "min_return": (1, lambda n: _N("r", n)),
    "return_dispersion": (-1, lambda n: _M("ar", n)),
    "volume_rank": (1, lambda n: _place("vol", n)),
    "amount_surge": (1, lambda n: f"{_d('amount', _M('amount', n))} - 1"),
    "money_flow": (1, lambda n: _d(_T("flow", n), _T("vol", n))),
    "volume_weighted_return": (1, lambda n: _d(_T("rv", n), _T("vol", n))),
    "moving_average_change": (1, lambda n: f"{_d(_M('close', n), _M('close', n, n))} - 1"),
}
_DAY_SQL = {"intraday_strength": (1, _d("close - open", "high - low")), "gap_reversal": (-1, f"{_d('open', 'c1')} - 1"), "amplitude_1": (-1, _d("high - low", "close"))}
_VALUE_SQL = {
    "earnings_yield": (1, _d("1.0", "pe_ttm")), "book_yield": (1, _d("1.0", "pb")), "sales_yield": (1, _d("1.0", "ps_ttm")), "dividend_yield": (1, "dv_ttm"), "small_size": (-1, "CASE WHEN total_mv > 0 THEN ln(total_mv) END"),
    "small_float_size": (-1, "CASE WHEN circ_mv > 0 THEN ln(circ_mv) END"), "turnover": (-1, "turnover_rate"), "free_turnover": (-1, "turnover_rate_f"), "volume_ratio": (1, "volume_ratio"), "float_fraction": (1, _d("float_share", "total_share")),
    "free_float_fraction": (1, _d("free_share", "total_share")), "valuation_spread": (1, f"{_d('pe', 'pe_ttm')} - 1"),
}


def add_recipe(name: str, made: dict[str, tuple[int, f.Factor]], texts: dict[str, tuple[int, str]], digits: int = 6, base: str = "grid", prepare=None, sql: str = "", extra: str = "", source: str = "made") -> None:
    """A query of directed factors against SQL of their definitions; `extra` are further tables, `source` the last one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = grid_of(spark, sf_dir)
        out = f.evaluate(prepare(grid) if prepare else grid, {n: x for n, (_, x) in made.items()}, {n: d for n, (d, _) in made.items()})
        return out.select("ts_code", "trade_date", *[rounded(c, digits).alias(c) for c in made])

    values = ", ".join(f"({x}) AS {n}" for n, (_, x) in texts.items())
    final = ", ".join(rounded_sql(f"CASE WHEN isfinite({n}) AND base_close IS NOT NULL THEN {n} * {d} END", digits) + f" AS {n}" for n, (d, _) in texts.items())
    text = f"WITH {adapter.PANEL_SQL}{',' + sql if sql else ''},\n{_CELLS.format(base=base)}{extra},\nvalued AS (SELECT ts_code, trade_date, close AS base_close, {values} FROM {source})\nSELECT ts_code, trade_date, {final} FROM valued"
    register(name, query, text)


for _name, _recipe in recipes.PRICE_RECIPES.items():
    _ns = (5, 10, 20, *recipes.EXTRA_WINDOWS.get(_name, ()))
    _way, _text = _RECIPE_SQL[_name]
    add_recipe(f"recipe_{_name}", {f"{_name}_{n}": (_recipe.direction, _recipe.build(n)) for n in _ns}, {f"{_name}_{n}": (_way, _text(n)) for n in _ns}, digits=12 if _name == "illiquidity" else 6)
add_recipe("recipe_single_day", {n: (q.direction, q.build(1)) for n, q in recipes.DAY_RECIPES.items()}, _DAY_SQL)
_BASIC = {"base": "basics", "prepare": with_basics, "sql": BASICS_SQL}
add_recipe("recipe_valuation", {f"{n}_v": (q.direction, q.build(1)) for n, q in recipes.valuation().items()}, {f"{n}_v": x for n, x in _VALUE_SQL.items()}, **_BASIC)
add_recipe(
    "recipe_valuation_smooth",
    {f"{n}_{k}": (q.direction, q.build(k)) for k in (5, 20) for n, q in recipes.valuation(k).items()},
    {f"{n}_{k}": (way, _M(f"v_{n}", k)) for k in (5, 20) for n, (way, _) in _VALUE_SQL.items()},
    extra=f", levels AS (SELECT *, {', '.join(f'({x}) AS v_{n}' for n, (_, x) in _VALUE_SQL.items())} FROM made)",
    source="levels",
    **_BASIC,
)
_CHANGING = {"turnover_rate": 1, "turnover_rate_f": 1, "volume_ratio": 1, "pe_ttm": -1, "pb": -1, "total_mv": 1}
add_recipe("recipe_relative_change", recipes.relative_changes(), {f"{c}_relative_{n}": (way, f"{_d(c, _back(c, n))} - 1") for c, way in _CHANGING.items() for n in (20, 60, 120)}, **_BASIC)
_plain = lambda made: {n: (1, x) for n, x in made.items()}
add_recipe("recipe_report", _plain(recipes.report_recipes("pb", per_share=True)), _plain({"level": "pb", "change_20": f"pb - {_back('pb', 20)}", "change_60": f"pb - {_back('pb', 60)}", "price_yield": _d("pb", "raw_close")}), **_BASIC)
_DAY = "(PARTITION BY trade_date)"
add_recipe(
    "recipe_external",
    _plain(recipes.external_templates("pb")),
    _plain({
        "level": "pb", "cross_section_rank": f"CASE WHEN pb IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY pb NULLS LAST) + (count(pb) OVER (PARTITION BY trade_date, pb) - 1) / 2.0) / count(pb) OVER {_DAY} END",
        "cross_section_zscore": _d(f"pb - avg(pb) OVER {_DAY}", f"stddev_pop(pb) OVER {_DAY}"), "lag_1": _back("pb", 1), "change_20": f"pb - {_back('pb', 20)}", "change_60": f"pb - {_back('pb', 60)}", "mean_20": _M("pb", 20), "time_rank_60": _place("pb", 60),
    }),
    **_BASIC,
)
_INDEX = {"base": "indexed", "prepare": with_index, "sql": INDEX_SQL}
_IR = ", moved AS (SELECT *, ext_ctx_close / lag(ext_ctx_close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS ir FROM made), both_moved AS (SELECT *, r * ir AS rir FROM moved)"
add_recipe(
    "recipe_context",
    _plain(recipes.context_recipes("ext_ctx_close", "ext_ctx_amount")),
    _plain({
        "price": "ext_ctx_close", "momentum20": f"{_d('ext_ctx_close', _back('ext_ctx_close', 20))} - 1", "momentum60": f"{_d('ext_ctx_close', _back('ext_ctx_close', 60))} - 1", "volatility20": _S("ir", 20),
        "drawdown60": f"{_d('ext_ctx_close', _X('ext_ctx_close', 60))} - 1", "amount20": f"{_d('ext_ctx_amount', _M('ext_ctx_amount', 20))} - 1",
    }),
    extra=_IR,
    source="both_moved",
    **_INDEX,
)
_BETA = _d(f"{_M('rir', 20)} - {_M('r', 20)} * {_M('ir', 20)}", f"{_S('ir', 20)} * {_S('ir', 20)}")
_BETA60 = _BETA.replace("= 20", "= 60").replace("BETWEEN 19", "BETWEEN 59")
_MOMENTUM = f"{_d('close', _back('close', 20))} - {_d('ext_ctx_close', _back('ext_ctx_close', 20))}"
add_recipe("recipe_rolling_beta", _plain(recipes.rolling_beta("ext_ctx_close")), _plain({"beta60": _BETA60, "exposure_shock": f"{_BETA60} * ir", "relative_momentum20": _MOMENTUM}), digits=5, extra=_IR, source="both_moved", **_INDEX)
add_recipe("recipe_rolling_beta20", _plain(recipes.rolling_beta("ext_ctx_close", 20)), _plain({"beta20": _BETA, "exposure_shock": f"{_BETA} * ir", "relative_momentum20": _MOMENTUM}), digits=5, extra=_IR, source="both_moved", **_INDEX)
add_recipe("recipe_index_level", _plain({"index_level": f.field("ext_ctx_close")}), _plain({"index_level": "ext_ctx_close"}), **_INDEX)

_LAG = "lag({x}, 2) OVER (PARTITION BY ts_code ORDER BY trade_date)"
_TRAIL = "(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_SQL = {
    "identity": "x",
    "log_positive": "CASE WHEN x > 0 THEN ln(x) END",
    "log1p_nonnegative": "CASE WHEN x >= 0 THEN ln(1 + x) END",
    "reciprocal_nonzero": "CASE WHEN x <> 0 THEN 1 / x END",
    "percent_to_fraction": "x / 100",
    "signed_log1p": "sign(x) * ln(1 + abs(x) / 10)",
    "first_difference": "x - before",
    "simple_return": "CASE WHEN x > 0 AND before > 0 THEN x / before - 1 END",
    "log_return": "CASE WHEN x > 0 AND before > 0 THEN ln(x / before) END",
}


def _transform(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = grid_of(spark, sf_dir).withColumn("x", F.col("close") - 1000)
        return transforms.apply_transform(grid, "x", kind, lag=2, unit=10.0).select("ts_code", "trade_date", rounded("value").alias("value"))

    return query


for _kind, _text in _SQL.items():
    register(
        f"transform_{_kind}",
        _transform(_kind),
        f"WITH {adapter.PANEL_SQL}, t AS (SELECT ts_code, trade_date, close - 1000 AS x, lag(close - 1000, 2) OVER (PARTITION BY ts_code ORDER BY trade_date) AS before FROM grid), v AS (SELECT *, {_text} AS value FROM t) SELECT ts_code, trade_date, {rounded_sql('value')} AS value FROM v",
    )


def _over_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transforms.apply_transform(grid_of(spark, sf_dir), "close", "return_over_trailing_volatility")
    return made.select("ts_code", "trade_date", rounded("value").alias("value"))


register(
    "transform_return_over_trailing_volatility",
    _over_volatility,
    f"""WITH {adapter.PANEL_SQL}, t AS (SELECT *, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS r FROM grid),
    v AS (SELECT *, count(r) OVER {_TRAIL} AS n, stddev_samp(r) OVER {_TRAIL} AS s FROM t),
    o AS (SELECT ts_code, trade_date, CASE WHEN n = 20 AND s > 1e-8 THEN r / s END AS value FROM v)
    SELECT ts_code, trade_date, {rounded_sql('value')} AS value FROM o""",
)
_TYPES = {"close": "price", "total_mv": "size", "vol": "flow", "pe": "multiple", "dv_ratio": "percent", "amount": "currency", "pb": "ratio"}


def _default(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transforms.default_transform(with_basics(grid_of(spark, sf_dir)), _TYPES)
    return made.select("ts_code", "trade_date", *[rounded(f"{c}_t").alias(f"{c}_t") for c in _TYPES])


register(
    "transform_default",
    _default,
    f"""WITH {adapter.PANEL_SQL},{BASICS_SQL}, t AS (SELECT ts_code, trade_date, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS close_t,
    CASE WHEN total_mv > 0 THEN ln(total_mv) END AS total_mv_t, ln(1 + vol) AS vol_t, CASE WHEN pe <> 0 THEN 1 / pe END AS pe_t, dv_ratio / 100 AS dv_ratio_t,
    sign(amount) * ln(1 + abs(amount)) AS amount_t, pb AS pb_t FROM basics)
    SELECT ts_code, trade_date, {', '.join(f"{rounded_sql(c + '_t')} AS {c}_t" for c in _TYPES)} FROM t""",
)
