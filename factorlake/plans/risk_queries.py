"""Queries of pools' covariances, portfolios' volatility and the limits that they break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import risk
from ..sources import adapter
from .basket_queries import DAYS, four_weeks
from .registry import register, rounded, rounded_sql
from .source_queries import number, round_sql, select_round

LOOKBACK, SHRINK = 20, 0.1
NET, TARGET, LIMITS = 0.9, 8.0, {"size": 0.8, "swing": 0.9}


def pools(s: SparkSession, d: str) -> DataFrame:
    """Clipped simple returns and two factors of pools of ten symbols, at all four-week sessions."""
    made = f.evaluate(four_weeks(s, d), {"r": f.clip(f.returns(f.field("close"), 1), -1, 1), "size": f.log(f.field("vol")), "swing": (f.field("high") - f.field("low")) / f.field("close")})
    return made.select(F.concat(F.lit("B"), F.floor((number() - 1) / 10).cast("string")).alias("basket_id"), "ts_code", "session_index", "vol", "r", "size", "swing")


def weights(s: SparkSession, d: str) -> DataFrame:
    """By the volume of the session: long the busy symbols, short the quiet ones; what lies between isn't held."""
    w = F.when(F.col("vol") > 300, 0.25).when(F.col("vol") < 200, -0.25).otherwise(0.0)
    return pools(s, d).filter("vol IS NOT NULL").select("basket_id", "ts_code", "session_index", w.alias("weight"))


def covariance(s: SparkSession, d: str) -> DataFrame:
    return risk.risk_covariance(pools(s, d).select("basket_id", "ts_code", "session_index", "r"), LOOKBACK, SHRINK)


_P = f"""{adapter.panel_sql(DAYS)},
pools AS (SELECT 'B' || floor((substr(ts_code, 2)::BIGINT - 1) / 10.0)::BIGINT AS basket_id, ts_code, session_index, vol,
    CASE WHEN close IS NOT NULL AND before IS NOT NULL AND abs(before) > 1e-12 THEN least(greatest(close / before - 1, -1.0), 1.0) END AS r, CASE WHEN close IS NOT NULL AND vol > 0 THEN ln(vol) END AS size, (high - low) / close AS swing
  FROM (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS before FROM grid)),
pairs AS (SELECT x.basket_id, x.session_index, x.ts_code AS a, y.ts_code AS b, x.r AS ra, y.r AS rb FROM pools x JOIN pools y USING (basket_id, session_index)),
covs AS (SELECT basket_id, session_index, a, b, CASE WHEN count(ra) OVER w = {LOOKBACK} AND count(rb) OVER w = {LOOKBACK} THEN covar_samp(ra, rb) OVER w * 252 * CASE WHEN a = b THEN 1.0 ELSE {1 - SHRINK} END END AS cov
  FROM pairs WINDOW w AS (PARTITION BY basket_id, a, b ORDER BY session_index ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
weights AS (SELECT basket_id, ts_code, session_index, CASE WHEN vol > 300 THEN 0.25 WHEN vol < 200 THEN -0.25 ELSE 0.0 END::DOUBLE AS weight FROM pools WHERE vol IS NOT NULL)"""
_VOLS = f"""{_P},
held AS (SELECT * FROM weights WHERE abs(weight) > 1e-10),
known AS (SELECT h.basket_id, h.session_index, count(*) AS active, count(*) FILTER (c.cov IS NULL) AS unavailable FROM held h LEFT JOIN covs c ON c.basket_id = h.basket_id AND c.session_index = h.session_index AND c.a = h.ts_code AND c.b = h.ts_code GROUP BY ALL),
forms AS (SELECT c.basket_id, c.session_index, sum(x.weight * y.weight * cov) AS v FROM covs c JOIN held x ON x.basket_id = c.basket_id AND x.session_index = c.session_index AND x.ts_code = c.a JOIN held y ON y.basket_id = c.basket_id AND y.session_index = c.session_index AND y.ts_code = c.b GROUP BY ALL),
vols AS (SELECT k.*, CASE WHEN unavailable = 0 THEN sqrt(greatest(v, 0.0)) END AS volatility FROM known k LEFT JOIN forms USING (basket_id, session_index))"""
_SCORES = """scores AS (SELECT basket_id, session_index + 1 AS session_index, ts_code, CASE WHEN count(size) OVER p = count(*) OVER p AND stddev_pop(size) OVER p >= 1e-12 THEN (size - avg(size) OVER p) / stddev_pop(size) OVER p END AS size,
    CASE WHEN count(swing) OVER p = count(*) OVER p AND stddev_pop(swing) OVER p >= 1e-12 THEN (swing - avg(swing) OVER p) / stddev_pop(swing) OVER p END AS swing FROM pools WINDOW p AS (PARTITION BY basket_id, session_index)),
exposures AS (SELECT h.basket_id, h.session_index, CASE WHEN count(size) = count(*) THEN sum(weight * size) END AS size, CASE WHEN count(swing) = count(*) THEN sum(weight * swing) END AS swing FROM held h LEFT JOIN scores USING (basket_id, session_index, ts_code) GROUP BY ALL)"""
_K = ("basket_id", "session_index")

register("risk_covariance", lambda s, d: select_round(covariance(s, d), (*_K, "a", "b"), ("cov",)), f"WITH {_P} SELECT basket_id, session_index, a, b, {rounded_sql('cov')} AS cov FROM covs WHERE cov IS NOT NULL")
register("portfolio_volatility", lambda s, d: select_round(risk.portfolio_volatility(weights(s, d), covariance(s, d)), (*_K, "active", "unavailable"), ("volatility",)), f"WITH {_VOLS} SELECT basket_id, session_index, active, unavailable, {rounded_sql('volatility')} AS volatility FROM vols")
register(
    "portfolio_exposures",
    lambda s, d: select_round(risk.portfolio_exposures(weights(s, d), risk.factor_scores(pools(s, d), list(LIMITS)), list(LIMITS)), _K, tuple(LIMITS)),
    f"WITH {_VOLS}, {_SCORES} SELECT basket_id, session_index, {round_sql(tuple(LIMITS))} FROM exposures",
)


def breaches(s: SparkSession, d: str) -> DataFrame:
    made = risk.portfolio_risk(weights(s, d), NET, covariance(s, d), TARGET, risk.factor_scores(pools(s, d), list(LIMITS)), LIMITS)
    return made.select(*_K, rounded("gross").alias("gross"), rounded("net").alias("net"), rounded("volatility").alias("volatility"), F.concat_ws(",", "issues").alias("issues"))


register(
    "risk_breaches_all",
    breaches,
    f"""WITH {_VOLS}, {_SCORES}, t AS (SELECT basket_id, session_index, sum(abs(weight)) AS gross, sum(weight) AS net, count(*) FILTER (abs(weight) > 1e-10) AS held FROM weights GROUP BY ALL),
    j AS (SELECT t.*, volatility, size, swing FROM t LEFT JOIN vols USING (basket_id, session_index) LEFT JOIN exposures USING (basket_id, session_index))
    SELECT basket_id, session_index, {round_sql(('gross', 'net', 'volatility'))}, concat_ws(',', CASE WHEN abs(net) > {NET} + 1e-10 THEN 'net_exposure_limit' END,
      CASE WHEN held > 0 THEN CASE WHEN volatility IS NULL THEN 'volatility_history_unavailable' WHEN volatility * volatility > {TARGET**2} + 1e-12 THEN 'volatility_target_limit' END END,
      {", ".join(f"CASE WHEN held > 0 THEN CASE WHEN {c} IS NULL THEN 'factor_exposure_unavailable:{c}' WHEN abs({c}) > {v} + 1e-10 THEN 'factor_exposure_limit:{c}' END END" for c, v in LIMITS.items())}) AS issues FROM j""",
)
