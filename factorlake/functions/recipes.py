"""Named factors. A recipe is a function of its window; its direction says whether more is better."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from .factors import Factor, absolute, delta, field, lag, log, max2, min2, rank, returns, sign, sqrt, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum, zscore

#: Windows that the catalogue offers.
WINDOWS = (5, 10, 20, 40, 60, 120, 180, 252)


@dataclass(frozen=True)
class Recipe:
    direction: int
    build: Callable[[int], Factor]


_open, _high, _low, _close, _vol, _amount = map(field, ("open", "high", "low", "close", "vol", "amount"))
_r = returns(_close, 1)

# Names, formulas and directions of the catalogue.
PRICE_RECIPES: dict[str, Recipe] = {
    "momentum": Recipe(1, lambda n: returns(_close, n)),
    "reversal": Recipe(-1, lambda n: returns(_close, n)),
    "volatility": Recipe(-1, lambda n: ts_std(_r, n)),
    "range": Recipe(-1, lambda n: ts_mean((_high - _low) / _close, n)),
    "volume_surge": Recipe(1, lambda n: _vol / ts_mean(_vol, n) - 1),
    "volume_variation": Recipe(-1, lambda n: ts_std(_vol, n) / ts_mean(_vol, n)),
    "liquidity": Recipe(1, lambda n: log(ts_mean(_amount, n))),
    "illiquidity": Recipe(-1, lambda n: ts_mean(absolute(_r) / max2(_amount, 1), n)),
    "trend_strength": Recipe(1, lambda n: _close / ts_mean(_close, n) - 1),
    "range_position": Recipe(1, lambda n: (_close - ts_min(_low, n)) / (ts_max(_high, n) - ts_min(_low, n))),
    "rsi_ratio": Recipe(1, lambda n: ts_mean(max2(delta(_close, 1), 0), n) / ts_mean(absolute(delta(_close, 1)), n)),
    "downside_risk": Recipe(-1, lambda n: sqrt(ts_mean(min2(_r, 0) * min2(_r, 0), n))),
    "overnight_momentum": Recipe(1, lambda n: ts_mean(_open / lag(_close, 1) - 1, n)),
    "intraday_momentum": Recipe(1, lambda n: ts_mean((_close - _open) / _open, n)),
    "breakout": Recipe(1, lambda n: _close / lag(ts_max(_high, n), 1) - 1),
    "drawdown": Recipe(1, lambda n: _close / ts_max(_close, n) - 1),
    "rebound": Recipe(-1, lambda n: _close / ts_min(_close, n) - 1),
    "trend_efficiency": Recipe(1, lambda n: delta(_close, n) / ts_sum(absolute(delta(_close, 1)), n)),
    "trend_persistence": Recipe(1, lambda n: ts_mean(sign(max2(_r, 0)), n)),
    "mean_return": Recipe(1, lambda n: ts_mean(_r, n)),
    "historical_sharpe": Recipe(1, lambda n: ts_mean(_r, n) / ts_std(_r, n)),
    "bollinger_position": Recipe(1, lambda n: (_close - ts_mean(_close, n)) / ts_std(_close, n)),
    "parkinson_volatility": Recipe(-1, lambda n: sqrt(ts_mean(log(_high / _low) * log(_high / _low), n) / (4 * math.log(2)))),
    "max_return": Recipe(-1, lambda n: ts_max(_r, n)),
    "min_return": Recipe(1, lambda n: ts_min(_r, n)),
    "return_dispersion": Recipe(-1, lambda n: ts_mean(absolute(_r), n)),
    "volume_rank": Recipe(1, lambda n: ts_rank(_vol, n)),
    "amount_surge": Recipe(1, lambda n: _amount / ts_mean(_amount, n) - 1),
    "money_flow": Recipe(1, lambda n: ts_sum((2 * _close - _high - _low) / (_high - _low) * _vol, n) / ts_sum(_vol, n)),
    "volume_weighted_return": Recipe(1, lambda n: ts_sum(_r * _vol, n) / ts_sum(_vol, n)),
    "moving_average_change": Recipe(1, lambda n: ts_mean(_close, n) / lag(ts_mean(_close, n), n) - 1),
}

DAY_RECIPES: dict[str, Recipe] = {
    "intraday_strength": Recipe(1, lambda n=1: (_close - _open) / (_high - _low)),
    "gap_reversal": Recipe(-1, lambda n=1: _open / lag(_close, 1) - 1),
    "amplitude_1": Recipe(-1, lambda n=1: (_high - _low) / _close),
}
#: Windows that single families have besides WINDOWS.
EXTRA_WINDOWS = {"reversal": (1,), "rsi_ratio": (14,)}
SMOOTHING = (5, 20, 60, 120)
CHANGES = (20, 60, 120)
#: Daily fields whose change is a factor, with its direction.
CHANGING = {"turnover_rate": 1, "turnover_rate_f": 1, "volume_ratio": 1, "pe_ttm": -1, "pb": -1, "total_mv": 1}


def valuation(n: int = 1) -> dict[str, Recipe]:
    """Yields from valuation multiples, size and turnover, as they are or as a mean over n sessions."""
    smooth = (lambda x: x) if n == 1 else (lambda x: ts_mean(x, n))
    x = field
    made = {
        "earnings_yield": (1, 1 / x("pe_ttm")),
        "book_yield": (1, 1 / x("pb")),
        "sales_yield": (1, 1 / x("ps_ttm")),
        "dividend_yield": (1, x("dv_ttm")),
        "small_size": (-1, log(x("total_mv"))),
        "small_float_size": (-1, log(x("circ_mv"))),
        "turnover": (-1, x("turnover_rate")),
        "free_turnover": (-1, x("turnover_rate_f")),
        "volume_ratio": (1, x("volume_ratio")),
        "float_fraction": (1, x("float_share") / x("total_share")),
        "free_float_fraction": (1, x("free_share") / x("total_share")),
        "valuation_spread": (1, x("pe") / x("pe_ttm") - 1),
    }
    return {name: Recipe(direction, lambda _, f=f: smooth(f)) for name, (direction, f) in made.items()}


def relative_change(name: str, n: int) -> Factor:
    return field(name) / lag(field(name), n) - 1


def relative_changes() -> dict[str, tuple[int, Factor]]:
    return {f"{name}_relative_{n}": (direction, relative_change(name, n)) for name, direction in CHANGING.items() for n in CHANGES}


def report_recipes(name: str, per_share: bool = False) -> dict[str, Factor]:
    """A disclosed level, its change over 20 and 60 sessions, and per-share values over the raw price."""
    x = field(name)
    made = {"level": x, "change_20": delta(x, 20), "change_60": delta(x, 60)}
    return made | ({"price_yield": x / field("raw_close")} if per_share else {})


def external_templates(name: str) -> dict[str, Factor]:
    x = field(name)
    return {"level": x, "cross_section_rank": rank(x), "cross_section_zscore": zscore(x), "lag_1": lag(x, 1), "change_20": delta(x, 20), "change_60": delta(x, 60), "mean_20": ts_mean(x, 20), "time_rank_60": ts_rank(x, 60)}


def context_recipes(price: str, amount: str) -> dict[str, Factor]:
    """Level, momentum, volatility, drawdown and relative amount of an index that all symbols share."""
    p, a = field(price), field(amount)
    return {"price": p, "momentum20": returns(p, 20), "momentum60": returns(p, 60), "volatility20": ts_std(returns(p, 1), 20), "drawdown60": p / ts_max(p, 60) - 1, "amount20": a / ts_mean(a, 20) - 1}


def rolling_beta(index: str, n: int = 60) -> dict[str, Factor]:
    """Slope of own on index returns, the move that it explains, and momentum beyond the index over 20 sessions."""
    a, b = _r, returns(field(index), 1)
    beta = (ts_mean(a * b, n) - ts_mean(a, n) * ts_mean(b, n)) / (ts_std(b, n) * ts_std(b, n))
    return {f"beta{n}": beta, "exposure_shock": beta * b, "relative_momentum20": returns(_close, 20) - returns(field(index), 20)}


def all_recipes(windows: tuple[int, ...] = WINDOWS) -> dict[str, tuple[int, Factor]]:
    """The catalogue of prices and volumes: every recipe at every window, and the one-day recipes."""
    priced = {f"{name}_{n}": (r.direction, r.build(n)) for name, r in PRICE_RECIPES.items() for n in (*windows, *EXTRA_WINDOWS.get(name, ()))}
    return priced | {name: (r.direction, r.build(1)) for name, r in DAY_RECIPES.items()}


def daily_recipes() -> dict[str, tuple[int, Factor]]:
    """The catalogue of daily valuation fields: levels, means and relative changes."""
    made = {f"{name}{f'_smooth_{n}' if n > 1 else ''}": (r.direction, r.build(n)) for n in (1, *SMOOTHING) for name, r in valuation(n).items()}
    return made | relative_changes()


__all__ = [
    "CHANGING", "DAY_RECIPES", "EXTRA_WINDOWS", "PRICE_RECIPES", "WINDOWS", "Recipe", "all_recipes", "context_recipes", "daily_recipes", "external_templates", "relative_change", "relative_changes", "report_recipes", "rolling_beta", "valuation",
]
