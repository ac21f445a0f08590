"""Queries of residual baskets: ten symbols each, over sessions of four weeks, of which some lack a symbol's price."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import baskets
from ..operators.grid import complete_grid
from ..sources import adapter
from ..sources.shared import cut
from .registry import register, rounded, rounded_sql
from .source_queries import number, round_sql, select_round

DAYS = 28
FORMATION, WINDOW, REFIT, EVERY = 20, 12, 6, 2
ENTRY, LEAVE, STOP, LONGEST, HALF_LIFE = 1.0, 0.2, 2.5, 5, 3.0
EXPOSURES = ("size", "swing", "double_size")


def four_weeks(s: SparkSession, d: str, days: int = DAYS) -> DataFrame:
    """The complete grid of four-week sessions, or of sessions of so many days."""
    bars = adapter.panel(s, d, days)
    return complete_grid(bars, adapter.calendar(bars), adapter.symbols(s, d))


def basket_returns(s: SparkSession, d: str, days: int = DAYS) -> DataFrame:
    """Log returns of all legs at all sessions, null over a missing price, with three exposures (the third repeats the first)."""
    size = f.log(f.field("vol"))
    made = {"r": f.log(f.field("close") / f.lag(f.field("close"), 1)), "size": size, "swing": (f.field("high") - f.field("low")) / f.field("close"), "double_size": size * 2 + 1}
    basket = F.concat(F.lit("B"), F.floor((number() - 1) / 10).cast("string"))
    return f.evaluate(four_weeks(s, d, days), made).select(basket.alias("basket_id"), "ts_code", "session_index", "r", "close", *EXPOSURES)


class Chain:
    """Sessions, schedule and fits of all baskets, each made once when first asked for; `components` 0 is the residual
    against the basket's mean."""

    def __init__(self, s: SparkSession, d: str, components: int, exposures: tuple[str, ...] = ()):
        self.source, self.components, self.exposures = (s, d), components, exposures

    @cached_property
    def sessions(self) -> DataFrame:
        return cut(baskets.basket_sessions(basket_returns(*self.source), FORMATION, WINDOW, self.components, self.exposures))

    @cached_property
    def schedule(self) -> DataFrame:
        return cut(baskets.observe(self.sessions, FORMATION, REFIT, EVERY))

    @cached_property
    def fits(self) -> DataFrame:
        return cut(baskets.basket_fits(self.sessions, self.schedule, FORMATION, self.components, self.exposures))

    def scores(self) -> DataFrame:
        return baskets.residual_scores(self.sessions, self.fits, self.schedule, WINDOW)

    def signals(self) -> DataFrame:
        """With the sessions that the calendar has: an expiry after its end isn't told."""
        told = baskets.signal_states(self.scores(), ENTRY, LEAVE, STOP, LONGEST, HALF_LIFE)
        return told.join(self.sessions.select("session_index").distinct(), "session_index")

    def weights(self) -> DataFrame:
        return baskets.target_weights(cut(self.signals()), self.fits)


def pca(s: SparkSession, d: str) -> Chain:
    return Chain(s, d, 2, EXPOSURES)


def market(s: SparkSession, d: str) -> Chain:
    return Chain(s, d, 0)


_G = f"""{adapter.panel_sql(DAYS)},
rets AS (SELECT 'B' || floor((substr(ts_code, 2)::BIGINT - 1) / 10.0)::BIGINT AS basket_id, ts_code, session_index, close, CASE WHEN close > 0 AND before > 0 THEN ln(close / before) END AS r
  FROM (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS before FROM grid)),
small AS (SELECT basket_id FROM rets GROUP BY 1 HAVING count(DISTINCT ts_code) < 3),
legs AS (SELECT * FROM rets WHERE basket_id NOT IN (SELECT basket_id FROM small)),
days AS (SELECT basket_id, session_index, max((r IS NULL)::INT) AS gap FROM legs GROUP BY ALL),
gaps AS (SELECT basket_id, session_index, gap,
    CASE WHEN row_number() OVER w > {FORMATION} THEN sum(gap) OVER (w ROWS BETWEEN {FORMATION} PRECEDING AND 1 PRECEDING) END AS formation_gaps,
    CASE WHEN row_number() OVER w >= {WINDOW} THEN sum(gap) OVER (w ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) END AS residual_gaps
  FROM days WINDOW w AS (PARTITION BY basket_id ORDER BY session_index)),
seen AS (SELECT basket_id, session_index AS obs, coalesce(formation_gaps = 0, false) AS ok, residual_gaps, row_number() OVER (PARTITION BY basket_id ORDER BY session_index) AS i
  FROM gaps WHERE session_index >= {FORMATION + 1} AND (session_index - {FORMATION + 1}) % {EVERY} = 0),
plan AS (
  SELECT basket_id, obs, residual_gaps, i, CASE WHEN ok THEN obs END AS fit_at, CASE WHEN ok THEN 'fitted' ELSE 'incomplete_formation_window' END AS status FROM seen WHERE i = 1
  UNION ALL
  SELECT s.basket_id, s.obs, s.residual_gaps, s.i, CASE WHEN p.fit_at IS NULL OR s.obs - p.fit_at >= {REFIT} THEN CASE WHEN s.ok THEN s.obs END ELSE p.fit_at END,
    CASE WHEN p.fit_at IS NULL OR s.obs - p.fit_at >= {REFIT} THEN CASE WHEN s.ok THEN 'fitted' ELSE 'incomplete_formation_window' END ELSE 'kept' END
  FROM plan p JOIN seen s ON s.basket_id = p.basket_id AND s.i = p.i + 1)"""
_S = f"""{_G},
moved AS (SELECT basket_id, ts_code, session_index, coalesce(r, 0) - avg(coalesce(r, 0)) OVER (PARTITION BY basket_id, session_index) AS x FROM legs),
paths AS (SELECT *, sum(x) OVER (PARTITION BY basket_id, ts_code ORDER BY session_index) AS path FROM moved),
steps AS (SELECT *, lag(path) OVER (PARTITION BY basket_id, ts_code ORDER BY session_index) AS before FROM paths),
told AS (SELECT basket_id, ts_code, session_index, sum(x) OVER w AS level, CASE WHEN stddev_samp(path) OVER w > 1e-10 THEN (path - avg(path) OVER w) / stddev_samp(path) OVER w END AS z,
    CASE WHEN var_pop(before) OVER v * {WINDOW - 1} > 1e-16 THEN regr_slope(path, before) OVER v END AS ar1
  FROM steps WINDOW w AS (PARTITION BY basket_id, ts_code ORDER BY session_index ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), v AS (PARTITION BY basket_id, ts_code ORDER BY session_index ROWS BETWEEN {WINDOW - 2} PRECEDING AND CURRENT ROW)),
scores AS (
  SELECT basket_id, ts_code, session_index, i, fit_at, status, CASE WHEN status = 'valid' THEN level END AS level, CASE WHEN status = 'valid' THEN z END AS z, CASE WHEN status = 'valid' THEN ar1 END AS ar1,
    CASE WHEN status = 'valid' AND ar1 > 0 AND ar1 < 1 THEN -ln(2.0) / ln(ar1) END AS half_life
  FROM (SELECT t.*, p.i, p.fit_at, CASE WHEN p.fit_at IS NULL THEN p.status WHEN residual_gaps IS NULL OR residual_gaps > 0 THEN 'incomplete_residual_window' ELSE 'valid' END AS status
        FROM plan p JOIN told t ON t.basket_id = p.basket_id AND t.session_index = p.obs))"""
_WALK = f"""{_S},
ends AS (SELECT max(session_index) + 1 AS past FROM calendar),
clock AS (SELECT basket_id, ts_code, i, session_index AS obs, fit_at, status, z, half_life, coalesce(half_life <= {HALF_LIFE} AND z IS NOT NULL, false) AS ok FROM scores
  UNION ALL SELECT basket_id, ts_code, max(i) + 1, any_value(past), NULL, 'end', NULL, NULL, false FROM scores, ends GROUP BY ALL),
walk AS (
  SELECT basket_id, ts_code, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS opened, NULL::BIGINT AS obs, NULL::BIGINT AS fit_at, NULL::DOUBLE AS z, NULL::DOUBLE AS half_life, NULL::VARCHAR AS reason, NULL::BIGINT AS expired, NULL::BIGINT AS expired_fit, 0 AS held
  FROM (SELECT DISTINCT basket_id, ts_code FROM clock)
  UNION ALL
  SELECT basket_id, ts_code, i, CASE WHEN reason = 'enter' THEN CASE WHEN z > 0 THEN -1 ELSE 1 END WHEN reason = 'hold' THEN held ELSE 0 END, CASE WHEN reason = 'enter' THEN obs ELSE opened END, obs, fit_at, z, half_life, reason, expired, expired_fit, held
  FROM (SELECT *, CASE WHEN status <> 'valid' THEN status WHEN held <> 0 THEN CASE WHEN NOT ok THEN 'invalid_mean_reversion' WHEN abs(z) >= {STOP} THEN 'stop' WHEN held * z >= -{LEAVE} THEN 'converged' WHEN obs - opened >= {LONGEST} THEN 'time_exit' ELSE 'hold' END
      WHEN NOT ok THEN 'mean_reversion_not_established' WHEN abs(z) >= {ENTRY} AND abs(z) < {STOP} THEN 'enter' ELSE 'flat' END AS reason
    FROM (SELECT c.*, w.opened, CASE WHEN w.state <> 0 AND w.opened + {LONGEST} < c.obs THEN 0 ELSE w.state END AS held, CASE WHEN w.state <> 0 AND w.opened + {LONGEST} < c.obs THEN w.opened + {LONGEST} END AS expired, w.fit_at AS expired_fit
          FROM walk w JOIN clock c ON c.basket_id = w.basket_id AND c.ts_code = w.ts_code AND c.i = w.i + 1))),
signals AS (
  SELECT basket_id, ts_code, obs AS session_index, fit_at, z, half_life, state, reason, held <> 0 AND state = 0 AND reason NOT LIKE 'incomplete%' AS forced FROM walk WHERE reason IS NOT NULL AND reason <> 'end'
  UNION ALL SELECT basket_id, ts_code, expired, expired_fit, NULL, NULL, 0, 'time_exit_between_observations', true FROM walk WHERE expired IS NOT NULL)"""
_TARGETS = f"""{_WALK},
slots AS (SELECT basket_id, session_index, max(fit_at) AS fit_at FROM signals GROUP BY ALL),
known AS (SELECT s.basket_id, s.session_index, s.fit_at, l.ts_code, coalesce(last_value(g.state IGNORE NULLS) OVER (PARTITION BY s.basket_id, l.ts_code ORDER BY s.session_index), 0) AS state
  FROM slots s JOIN (SELECT DISTINCT basket_id, ts_code FROM signals) l USING (basket_id) LEFT JOIN signals g ON g.basket_id = s.basket_id AND g.ts_code = l.ts_code AND g.session_index = s.session_index),
raw AS (SELECT *, CASE WHEN fit_at IS NULL THEN 0.0 ELSE state - avg(state) OVER (PARTITION BY basket_id, session_index) END AS w FROM known),
targets AS (SELECT basket_id, session_index, ts_code, state, CASE WHEN sum(abs(w)) OVER p > 1e-10 THEN w / sum(abs(w)) OVER p ELSE 0.0 END AS weight FROM raw WINDOW p AS (PARTITION BY basket_id, session_index))"""

_K = ("basket_id", "ts_code", "session_index")
_V = ("level", "z", "ar1", "half_life")


def _signals(chain: Chain) -> DataFrame:
    return chain.signals().select(*_K, "fit_at", "state", "reason", "forced", rounded("z").alias("z"), rounded("half_life").alias("half_life"))


#: Sessions of two weeks before each fit that basket_refusals counts a basket's legs in.
REFUSED_OVER = 85


def _refusals(s: SparkSession, d: str) -> DataFrame:
    """Of all fits on sessions of two weeks, and of baskets as a whole, which have no fit_at."""
    returns = basket_returns(s, d, adapter.SESSION_DAYS)
    whole = baskets.basket_refusals(returns, 2, most=9).withColumn("fit_at", F.lit(None).cast("int"))
    return whole.unionByName(baskets.fit_refusals(returns, REFUSED_OVER, 2, most=9)).select("basket_id", "fit_at", "legs", "reason")


register(
    "basket_refusals",
    _refusals,
    f"""WITH {_G.split("small AS")[0].rstrip().rstrip(",").replace(adapter.panel_sql(DAYS), adapter.PANEL_SQL)},
    seen AS (SELECT basket_id, session_index, max((r IS NOT NULL)::INT) OVER (PARTITION BY basket_id, ts_code ORDER BY session_index RANGE BETWEEN {REFUSED_OVER} PRECEDING AND 1 PRECEDING) AS seen FROM rets),
    counted AS (SELECT basket_id, NULL::INT AS fit_at, count(DISTINCT ts_code) AS legs FROM rets GROUP BY 1
      UNION ALL SELECT basket_id, session_index::INT, count(*) FILTER (seen = 1) FROM seen WHERE session_index >= {REFUSED_OVER} GROUP BY ALL)
    SELECT basket_id, fit_at, legs, CASE WHEN legs > 9 THEN 'too_many_legs' ELSE 'too_few_legs' END AS reason FROM counted WHERE legs > 9 OR legs < 4""",
)
register(
    "rolling_refit_schedule_baskets",
    lambda s, d: market(s, d).schedule,
    f"WITH RECURSIVE {_G} SELECT basket_id, obs AS \"at\", fit_at, status FROM plan",
)
register("residual_levels", lambda s, d: select_round(market(s, d).scores(), (*_K, "fit_at", "status"), ("level",)), f"WITH RECURSIVE {_S} SELECT basket_id, ts_code, session_index, fit_at, status, {rounded_sql('level')} AS level FROM scores")
register("residual_zscore", lambda s, d: select_round(market(s, d).scores(), _K, ("z",)), f"WITH RECURSIVE {_S} SELECT basket_id, ts_code, session_index, {rounded_sql('z')} AS z FROM scores")
register("ar1_half_life", lambda s, d: select_round(market(s, d).scores(), _K, ("ar1", "half_life"), 4), f"WITH RECURSIVE {_S} SELECT basket_id, ts_code, session_index, {round_sql(('ar1', 'half_life'), 4)} FROM scores")
register("residual_signal_states", lambda s, d: _signals(market(s, d)).drop("z", "half_life"), f"WITH RECURSIVE {_WALK} SELECT basket_id, ts_code, session_index, fit_at, state, reason, forced FROM signals")
register("signal_reason_counts", lambda s, d: baskets.signal_reason_counts(market(s, d).signals()), f"WITH RECURSIVE {_WALK} SELECT reason, count(*) AS n FROM signals GROUP BY 1")
register("latest_signals", lambda s, d: baskets.latest_signals(market(s, d).signals()), f"WITH RECURSIVE {_WALK} SELECT basket_id, ts_code, max(session_index) AS session_index, arg_max(state, session_index) AS state, arg_max(reason, session_index) AS reason FROM signals GROUP BY ALL")
register("basket_weights", lambda s, d: select_round(market(s, d).weights(), (*_K, "state"), ("weight",)), f"WITH RECURSIVE {_TARGETS} SELECT basket_id, ts_code, session_index, state, {rounded_sql('weight')} AS weight FROM targets")
# Principal components and exposures have no SQL; the tests hold these against plain loops.
register("pca_residual_basket", lambda s, d: baskets.fit_matrix(pca(s, d).fits))
register("hedge_exposures", lambda s, d: pca(s, d).fits.select("basket_id", "fit_at", "exposures", "dropped", "rank", "freedom", "explained"))
register("frozen_baskets", lambda s, d: baskets.frozen_baskets(pca(s, d).fits))
register("pca_residual_scores", lambda s, d: pca(s, d).scores())
register("pca_signal_states", lambda s, d: pca(s, d).signals())
register("pca_basket_weights", lambda s, d: pca(s, d).weights())
