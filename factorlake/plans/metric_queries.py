"""Queries of diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import labels, metrics
from .factor_queries import grid_of
from .label_queries import COLS, FEATURES, SAMPLES_SQL, samples
from .registry import register, rounded, rounded_sql
from .source_queries import round_sql, select_round

_USED = "used AS (SELECT * FROM samples WHERE mom IS NOT NULL AND label IS NOT NULL)"
_RANKED = f"""{_USED}, ranked AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY mom) + (count(*) OVER (PARTITION BY trade_date, mom) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY trade_date ORDER BY label) + (count(*) OVER (PARTITION BY trade_date, label) - 1) / 2.0 AS b FROM used),
ics AS (SELECT trade_date, corr(a, b) AS ic, count(*) AS n FROM ranked GROUP BY 1 HAVING count(*) >= 3 AND min(mom) < max(mom) AND min(label) < max(label))"""
register("daily_rank_ic", lambda s, d: select_round(metrics.daily_rank_ic(samples(s, d), "mom", "label"), ("trade_date", "n"), ("ic",)), f"WITH {SAMPLES_SQL}, {_RANKED} SELECT trade_date, n, {rounded_sql('ic')} AS ic FROM ics")
_SUM = ("mean", "std", "icir")
register(
    "ic_summary",
    lambda s, d: select_round(metrics.ic_summary(metrics.daily_rank_ic(samples(s, d), "mom", "label")), ("count",), _SUM),
    f"WITH {SAMPLES_SQL}, {_RANKED}, t AS (SELECT avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS icir, count(ic) AS count FROM ics) SELECT count, {round_sql(_SUM)} FROM t",
)
register(
    "daily_pearson_ic",
    lambda s, d: select_round(metrics.daily_pearson_ic(samples(s, d), "mom", "label"), ("trade_date", "n"), ("ic",)),
    f"WITH {SAMPLES_SQL}, {_USED}, t AS (SELECT trade_date, count(*) AS n, corr(mom, label) AS ic FROM used GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(mom) > 1e-12 AND stddev_pop(label) > 1e-12) SELECT trade_date, n, {rounded_sql('ic')} AS ic FROM t",
)
_BUCKETS = f"""{_USED}, placed AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY mom, ts_code) - 1 AS i, count(*) OVER (PARTITION BY trade_date) AS n, min(mom) OVER (PARTITION BY trade_date) AS lo, max(mom) OVER (PARTITION BY trade_date) AS hi FROM used),
buckets AS (SELECT trade_date, floor(i * 5 / n)::BIGINT AS bucket, avg(label) AS mean, count(*) AS n FROM placed WHERE n >= 5 AND lo < hi GROUP BY ALL)"""
register("quantile_returns", lambda s, d: select_round(metrics.quantile_returns(samples(s, d), "mom", "label"), ("trade_date", "bucket", "n"), ("mean",)), f"WITH {SAMPLES_SQL}, {_BUCKETS} SELECT trade_date, bucket, n, {rounded_sql('mean')} AS mean FROM buckets")
register(
    "long_short_returns",
    lambda s, d: select_round(metrics.long_short(metrics.quantile_returns(samples(s, d), "mom", "label")), ("trade_date",), ("long_short",)),
    f"WITH {SAMPLES_SQL}, {_BUCKETS}, t AS (SELECT trade_date, max(mean) FILTER (bucket = 4) - max(mean) FILTER (bucket = 0) AS long_short FROM buckets GROUP BY 1) SELECT trade_date, {rounded_sql('long_short')} AS long_short FROM t",
)
register(
    "factor_coverage",
    lambda s, d: select_round(metrics.factor_coverage(samples(s, d), COLS), ("factor",), ("coverage",)),
    f"WITH {SAMPLES_SQL}, t AS (SELECT avg((mom IS NOT NULL)::INT) AS mom, avg((vola IS NOT NULL)::INT) AS vola, avg((surge IS NOT NULL)::INT) AS surge FROM samples WHERE close IS NOT NULL) SELECT factor, {rounded_sql('coverage')} AS coverage FROM (UNPIVOT t ON mom, vola, surge INTO NAME factor VALUE coverage)",
)


def _wide(s: SparkSession, d: str) -> DataFrame:
    return samples(s, d).withColumn("mixed", F.col("mom") * 3 + F.col("surge") * 0.05)


_COLS4 = ["mom", "vola", "surge", "mixed"]
_WIDE = f"{SAMPLES_SQL}, wide AS (SELECT *, mom * 3 + surge * 0.05 AS mixed FROM samples)"
_PAIRS = [(a, b) for i, a in enumerate(_COLS4) for b in _COLS4[i:]]
_STATS = "stats AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS corr, covar_samp({a}, {b}) AS cov FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS) + ")"
register("high_correlation_pairs", lambda s, d: select_round(metrics.high_correlation_pairs(_wide(s, d), _COLS4), ("a", "b", "n"), ("corr",)), f"WITH {_WIDE}, {_STATS} SELECT a, b, n, {rounded_sql('corr')} AS corr FROM stats WHERE a <> b AND n >= 30 AND abs(corr) >= 0.9 ORDER BY abs(corr) DESC, a, b LIMIT 50")
register("correlation_matrix", lambda s, d: select_round(metrics.pair_statistics(_wide(s, d), _COLS4), ("a", "b", "n"), ("corr", "cov")), f"WITH {_WIDE}, {_STATS} SELECT a, b, n, {round_sql(('corr', 'cov'))} FROM stats")
_D = ("mean", "variance", "std", "min", "q01", "q25", "median", "q75", "q99", "max")
register(
    "distribution",
    lambda s, d: select_round(metrics.distribution(samples(s, d), [*COLS, "label"]), ("column", "count"), _D),
    f"WITH {SAMPLES_SQL}, t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, var_samp({c}) AS variance, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.01) AS q01, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.99) AS q99, max({c}) AS max FROM samples" for c in [*COLS, "label"]) + f") SELECT \"column\", count, {round_sql(_D)} FROM t",
)
register(
    "missing_summary",
    lambda s, d: select_round(metrics.missing_summary(samples(s, d), COLS), ("column", "missing", "total"), ("fraction",)),
    f"WITH {SAMPLES_SQL}, t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS total, (count(*) - count({c})) / count(*) AS fraction FROM samples" for c in COLS) + f") SELECT \"column\", missing, total, {rounded_sql('fraction')} AS fraction FROM t",
)
register(
    "temporal_correlation",
    lambda s, d: select_round(metrics.temporal_correlation(samples(s, d), "mom", "label"), ("ts_code", "n"), ("pearson", "spearman")),
    f"""WITH {SAMPLES_SQL}, {_USED}, ranked AS (SELECT *, rank() OVER (PARTITION BY ts_code ORDER BY mom) + (count(*) OVER (PARTITION BY ts_code, mom) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ts_code ORDER BY label) + (count(*) OVER (PARTITION BY ts_code, label) - 1) / 2.0 AS b FROM used),
    t AS (SELECT ts_code, count(*) AS n, corr(mom, label) AS pearson, corr(a, b) AS spearman FROM ranked GROUP BY 1) SELECT ts_code, n, {round_sql(('pearson', 'spearman'))} FROM t""",
)
_OLS = ("slope", "intercept", "r2")
_OLSQL = "count(*) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2"
register("univariate_ols", lambda s, d: select_round(metrics.univariate_ols(samples(s, d), "mom", "label"), ("n",), _OLS), f"WITH {SAMPLES_SQL}, {_USED}, t AS (SELECT {_OLSQL.format(x='mom', y='label')} FROM used) SELECT n, {round_sql(_OLS)} FROM t")
register("univariate_ols_per_target", lambda s, d: select_round(metrics.univariate_ols(samples(s, d), "mom", "label", "ts_code"), ("ts_code", "n"), _OLS), f"WITH {SAMPLES_SQL}, {_USED}, t AS (SELECT ts_code, {_OLSQL.format(x='mom', y='label')} FROM used GROUP BY 1) SELECT ts_code, n, {round_sql(_OLS)} FROM t")
register(
    "contemporaneous_fit",
    lambda s, d: select_round(metrics.contemporaneous_fit(samples(s, d), "surge"), ("n",), _OLS),
    f"WITH {SAMPLES_SQL}, r AS (SELECT surge, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS r FROM samples), u AS (SELECT * FROM r WHERE surge IS NOT NULL AND r IS NOT NULL), t AS (SELECT {_OLSQL.format(x='surge', y='r')} FROM u) SELECT n, {round_sql(_OLS)} FROM t",
)
_EDGE = ", ".join(f"quantile_cont({{c}}, {p})" for p in (0.2, 0.4, 0.6, 0.8))
register(
    "joint_histogram",
    lambda s, d: select_round(metrics.joint_histogram(samples(s, d), samples(s, d).filter("trade_date < DATE '1999-01-01'"), "mom", "label"), ("bin_a", "bin_b", "n"), ("share",)),
    f"""WITH {SAMPLES_SQL}, {_USED}, e AS (SELECT [{_EDGE.format(c='mom')}] AS ea, [{_EDGE.format(c='label')}] AS eb FROM samples WHERE trade_date < DATE '1999-01-01'),
    c AS (SELECT len(list_filter(ea, lambda x: x < mom)) AS bin_a, len(list_filter(eb, lambda x: x < label)) AS bin_b, count(*) AS n FROM used, e GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER () AS share FROM c) SELECT bin_a, bin_b, n, {rounded_sql('share')} AS share FROM t""",
)


def forecasts(s: SparkSession, d: str) -> DataFrame:
    """Predicted moves that are a tenth of the momentum, with the actual ones."""
    made = labels.asset_price_labels(f.evaluate(grid_of(s, d), {"mom": FEATURES["mom"]}), 2)
    return made.select("ts_code", "trade_date", (F.col("mom") * -0.1).alias("p_in"), (F.col("mom") * -0.2).alias("p_out"), F.col("entry").alias("a_in"), F.col("exit").alias("a_out"))


_W = "(PARTITION BY ts_code ORDER BY trade_date)"
FORECASTS_SQL = f"{SAMPLES_SQL}, forecasts AS (SELECT ts_code, trade_date, mom * -0.1 AS p_in, mom * -0.2 AS p_out, (lead(open, 1) OVER {_W} - close) / abs(close) AS a_in, (lead(open, 3) OVER {_W} - close) / abs(close) AS a_out FROM samples), matured AS (SELECT * FROM forecasts WHERE p_in IS NOT NULL AND p_out IS NOT NULL AND a_in IS NOT NULL AND a_out IS NOT NULL)"
_FM = ("mse", "rmse", "mae", "entry_bias", "exit_bias", "entry_rmse", "exit_rmse", "remaining_rmse", "no_change_mse", "improvement", "relative_improvement")
register(
    "forecast_metrics",
    lambda s, d: select_round(metrics.forecast_metrics(forecasts(s, d)), ("observations", "dates"), _FM),
    f"""WITH {FORECASTS_SQL}, e AS (SELECT *, p_in - a_in AS e, p_out - a_out AS o FROM matured), d AS (SELECT trade_date, count(*) AS n, avg(e*e) AS e2, avg(o*o) AS o2, avg(abs(e)) AS ea, avg(abs(o)) AS oa, avg(e) AS eb, avg(o) AS ob, avg((o-e)*(o-e)) AS r2, avg(a_in*a_in) AS z1, avg(a_out*a_out) AS z2 FROM e GROUP BY 1),
    m AS (SELECT sum(n)::BIGINT AS observations, count(*) AS dates, (avg(e2) + avg(o2)) / 2 AS mse, (avg(ea) + avg(oa)) / 2 AS mae, avg(eb) AS entry_bias, avg(ob) AS exit_bias, sqrt(avg(e2)) AS entry_rmse, sqrt(avg(o2)) AS exit_rmse, sqrt(avg(r2)) AS remaining_rmse, (avg(z1) + avg(z2)) / 2 AS no_change_mse FROM d),
    t AS (SELECT *, sqrt(mse) AS rmse, no_change_mse - mse AS improvement, 1 - mse / no_change_mse AS relative_improvement FROM m) SELECT observations, dates, {round_sql(_FM)} FROM t""",
)
_RM = ("mse", "rmse", "mae", "bias", "zero_mse", "r2", "improvement", "relative_improvement", "pearson", "spearman")
register(
    "return_metrics",
    lambda s, d: select_round(metrics.return_metrics(forecasts(s, d), "p_out", "a_out"), ("observations",), _RM),
    f"""WITH {FORECASTS_SQL}, e AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra FROM (SELECT p_out AS p, a_out AS a, p_out - a_out AS e FROM forecasts WHERE p_out IS NOT NULL AND a_out IS NOT NULL)), m AS (SELECT count(*) AS observations, avg(e*e) AS mse, avg(abs(e)) AS mae, avg(e) AS bias, avg(a*a) AS zero_mse, var_pop(a) AS v, corr(p, a) AS pearson, corr(rp, ra) AS spearman FROM e),
    t AS (SELECT *, sqrt(mse) AS rmse, 1 - mse / v AS r2, zero_mse - mse AS improvement, 1 - mse / zero_mse AS relative_improvement FROM m) SELECT observations, {round_sql(_RM)} FROM t""",
)
register(
    "training_r2",
    lambda s, d: select_round(metrics.training_r2(forecasts(s, d), "p_out", "a_out"), (), ("r2",)),
    f"WITH {FORECASTS_SQL}, d AS (SELECT trade_date, avg(a_out) AS m, avg(a_out * a_out) AS s, avg((a_out - p_out) * (a_out - p_out)) AS e FROM forecasts WHERE p_out IS NOT NULL AND a_out IS NOT NULL GROUP BY 1), t AS (SELECT 1 - avg(e) / (avg(s) - avg(m) * avg(m)) AS r2 FROM d) SELECT {rounded_sql('r2')} AS r2 FROM t",
)
_DA = ("accuracy", "mae", "rmse")
register(
    "direction_accuracy",
    lambda s, d: select_round(metrics.direction_accuracy(forecasts(s, d), "p_out", "a_out"), ("observations",), _DA),
    f"WITH {FORECASTS_SQL}, t AS (SELECT count(*) AS observations, avg((sign(p_out) = sign(a_out))::INT) AS accuracy, avg(abs(p_out - a_out)) AS mae, sqrt(avg((p_out - a_out) * (p_out - a_out))) AS rmse FROM forecasts WHERE p_out IS NOT NULL AND a_out IS NOT NULL) SELECT observations, {round_sql(_DA)} FROM t",
)
register(
    "per_target_bias_rmse",
    lambda s, d: select_round(metrics.per_target_bias_rmse(forecasts(s, d), "p_out", "a_out"), ("ts_code", "n"), ("bias", "rmse")),
    f"WITH {FORECASTS_SQL}, t AS (SELECT ts_code, count(*) AS n, avg(p_out - a_out) AS bias, sqrt(avg((p_out - a_out) * (p_out - a_out))) AS rmse FROM forecasts WHERE p_out IS NOT NULL AND a_out IS NOT NULL GROUP BY 1) SELECT ts_code, n, {round_sql(('bias', 'rmse'))} FROM t",
)
register(
    "forecast_rank_report",
    lambda s, d: select_round(metrics.forecast_rank_report(samples(s, d), "mom"), ("ts_code", "trade_date", "rank", "is_latest"), ("percentile",)),
    f"""WITH {SAMPLES_SQL}, r AS (SELECT ts_code, trade_date, (count(*) OVER (PARTITION BY trade_date, mom) - 1) / 2.0 AS ties, rank() OVER (PARTITION BY trade_date ORDER BY mom) AS up, rank() OVER (PARTITION BY trade_date ORDER BY mom DESC) AS down, count(*) OVER (PARTITION BY trade_date) AS n, max(trade_date) OVER () AS latest FROM samples WHERE mom IS NOT NULL)
    SELECT ts_code, trade_date, down + ties AS rank, trade_date = latest AS is_latest, {rounded_sql('(up + ties) / n')} AS percentile FROM r""",
)
_RISK = {"volatility": f.ts_std(f.returns(f.field("close"), 1), 20) * 252**0.5, "downside": f.sqrt(f.ts_mean(f.min2(f.returns(f.field("close"), 1), 0) * f.min2(f.returns(f.field("close"), 1), 0), 20)) * 252**0.5}
_GRID = SAMPLES_SQL.split("labelled AS")[0].rstrip().rstrip(",")
register("trailing_risk", lambda s, d: select_round(f.evaluate(grid_of(s, d), _RISK), ("ts_code", "trade_date"), tuple(_RISK)), f"WITH {_GRID}, {f.factor_sql(_RISK)} SELECT ts_code, trade_date, {round_sql(tuple(_RISK))} FROM factors")
_CS = ("loss_improvement", "entry_bias", "exit_bias", "remaining_bias")
register(
    "date_cluster_stats",
    lambda s, d: select_round(metrics.date_cluster_stats(forecasts(s, d)), ("trade_date",), _CS),
    f"WITH {FORECASTS_SQL}, e AS (SELECT *, a_in - p_in AS e, a_out - p_out AS o FROM matured), t AS (SELECT trade_date, avg((a_in * a_in + a_out * a_out - e * e - o * o) / 2) AS loss_improvement, avg(e) AS entry_bias, avg(o) AS exit_bias, avg(o - e) AS remaining_bias FROM e GROUP BY 1) SELECT trade_date, {round_sql(_CS)} FROM t",
)
register("block_bootstrap_ci", lambda s, d: metrics.block_bootstrap_ci(metrics.date_cluster_stats(forecasts(s, d)), list(_CS), 2, 1))
register(
    "input_coverage",
    lambda s, d: metrics.input_coverage(samples(s, d).withColumn("reason", F.when(F.col("session_index") < 5, "warm_up").when(F.col("close").isNull(), "no_origin_price")), COLS),
    f"WITH {SAMPLES_SQL}, t AS (SELECT *, CASE WHEN session_index < 5 THEN 'warm_up' WHEN close IS NULL THEN 'no_origin_price' ELSE 'valid' END AS reason FROM samples) SELECT reason, count(*) AS n_rows, count(mom) AS mom, count(vola) AS vola, count(surge) AS surge FROM t GROUP BY 1",
)
__all__ = ["FORECASTS_SQL", "forecasts", "rounded"]
