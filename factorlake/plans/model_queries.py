"""Queries of models and time-ordered validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, labels, linear, models, preprocess, validation
from ..operators.models import ModelSpec
from ..sources.shared import cut
from .label_queries import COLS, SAMPLES_SQL, samples, sessions
from .metric_queries import FORECASTS_SQL, forecasts
from .registry import register, rounded, rounded_sql
from .source_queries import number, round_sql, select_round

K = ("ts_code", "trade_date")
CUT = "1999-01-01"
_P = SAMPLES_SQL.split("labelled AS")[0].rstrip().rstrip(",")


def tame(s: SparkSession, d: str) -> DataFrame:
    """Samples with features and label clipped, so that fits are not of a few prices alone."""
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(-2.0)), F.lit(2.0))) for c in [*COLS, "label"]}
    return samples(s, d).withColumns(clipped)


def kept(s: SparkSession, d: str) -> DataFrame:
    """The columns that models take, made once for all that reads them."""
    return cut(tame(s, d).select(*K, "session_index", "close", "label_end", *COLS, "label"))


def split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = kept(s, d)
    return rows.filter((F.col("trade_date") < F.lit(CUT).cast("date")) & (F.col("label_end") < F.lit(CUT).cast("date"))), rows.filter(F.col("trade_date") >= F.lit(CUT).cast("date"))


TAME_SQL = f"{SAMPLES_SQL}, tame AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, -2.0), 2.0) END AS {c}' for c in [*COLS, 'label'])}) FROM samples), train AS (SELECT * FROM tame WHERE trade_date < DATE '{CUT}' AND label_end < DATE '{CUT}'), test AS (SELECT * FROM tame WHERE trade_date >= DATE '{CUT}')"


def _pct(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, {c} IS NULL ORDER BY {c}) + (count({c}) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY trade_date) END AS {c}_p"


register(
    "factor_score",
    lambda s, d: select_round(models.factor_score(samples(s, d), COLS), K, ("score",)),
    f"WITH {SAMPLES_SQL}, r AS (SELECT ts_code, trade_date, {', '.join(_pct(c) for c in COLS)} FROM samples), t AS (SELECT ts_code, trade_date, list_avg([x for x in [mom_p, vola_p, surge_p] if x IS NOT NULL]) AS score FROM r) SELECT ts_code, trade_date, {rounded_sql('score')} AS score FROM t",
)
register("no_change", lambda s, d: models.no_change(split(s, d)[1]).select(*K, "prediction"), f"WITH {TAME_SQL} SELECT ts_code, trade_date, 0.0::DOUBLE AS prediction FROM test")
register("historical_drift", lambda s, d: select_round(models.historical_drift(*split(s, d), "label"), K, ("prediction",)), f"WITH {TAME_SQL}, m AS (SELECT avg(label) AS m FROM train) SELECT ts_code, trade_date, {rounded_sql('m')} AS prediction FROM test, m")
_TWO = ["mom", "surge"]
_SOLVE = """sums AS (SELECT {g} count(*) AS n, avg(mom) AS m1, avg(surge) AS m2, avg(label) AS m0, (var_pop(mom) * count(*)) + {a} AS a11, (var_pop(surge) * count(*)) + {a} AS a22, covar_pop(mom, surge) * count(*) AS a12, covar_pop(mom, label) * count(*) AS b1, covar_pop(surge, label) * count(*) AS b2
  FROM train WHERE mom IS NOT NULL AND surge IS NOT NULL AND label IS NOT NULL {by}),
w AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM sums), fits AS (SELECT *, m0 - w1 * m1 - w2 * m2 AS w0 FROM w WHERE n >= 4)"""
_POOLED, _EACH = _SOLVE.format(g="", a="10", by=""), _SOLVE.format(g="ts_code,", a="1", by="GROUP BY ts_code")


def _ridge(s: SparkSession, d: str) -> DataFrame:
    train, test = split(s, d)
    return select_round(models.score_linear(test, models.ridge_fits(train, _TWO, "label", 10.0, []), _TWO, []), K, ("prediction",), 5)


register("ridge", _ridge, f"WITH {TAME_SQL}, {_POOLED} SELECT ts_code, trade_date, {rounded_sql('w0 + w1 * mom + w2 * surge', 5)} AS prediction FROM test, fits")
register(
    "ridge_ml",
    lambda s, d: select_round(models.fit_predict(*split(s, d), _TWO, "label", ModelSpec("ridge", {"alpha": 10.0})), K, ("prediction",), 4),
    f"WITH {TAME_SQL}, {_POOLED} SELECT ts_code, trade_date, {rounded_sql('w0 + w1 * mom + w2 * surge', 4)} AS prediction FROM test, fits",
)
register(
    "ridge_per_target",
    lambda s, d: select_round(models.fit_predict(*split(s, d), _TWO, "label", ModelSpec("per_target_ridge", {"alpha": 1.0})), K, ("prediction",), 5),
    f"WITH {TAME_SQL}, {_EACH} SELECT t.ts_code, trade_date, {rounded_sql('w0 + w1 * mom + w2 * surge', 5)} AS prediction FROM test t LEFT JOIN fits f ON f.ts_code = t.ts_code",
)
register(
    "ridge_coefficients_per_target",
    lambda s, d: models.ridge_fits(split(s, d)[0], _TWO, "label", 1.0, ["ts_code"]).filter("coefficients IS NOT NULL").select("ts_code", "n", rounded("intercept", 5).alias("w0"), rounded(F.get("coefficients", F.lit(0)), 5).alias("w1"), rounded(F.get("coefficients", F.lit(1)), 5).alias("w2")),
    f"WITH {TAME_SQL}, {_EACH} SELECT ts_code, n, {round_sql(('w0', 'w1', 'w2'), 5)} FROM fits",
)
register(
    "score_linear",
    lambda s, d: select_round(models.score_linear(tame(s, d), s.createDataFrame([(0.01, [0.5, -0.25, 0.125])], "intercept double, coefficients array<double>"), COLS, []), K, ("prediction",)),
    f"WITH {TAME_SQL} SELECT ts_code, trade_date, {rounded_sql('0.01 + 0.5 * mom - 0.25 * vola + 0.125 * surge')} AS prediction FROM tame",
)
_NET = {"alpha": 1e-3, "l1_ratio": 0.5}
for _kind, _params in {
    "elastic_net": _NET, "gradient_boosting": {"rounds": 20}, "random_forest": {}, "huber": {}, "bayesian_ridge": {},
    "polynomial_ridge": {"alpha": 10.0}, "polynomial_elastic_net": _NET, "transformed_ridge": {"alpha": 10.0}, "factorwise_basis": _NET,
}.items():
    register(f"model_{_kind}", lambda s, d, m=ModelSpec(_kind, _params): models.fit_predict(*split(s, d), COLS, "label", m).select(*K, "prediction"))
register(
    "elastic_net_one_factor",
    lambda s, d: select_round(models.fit_predict(*split(s, d), ["mom"], "label", ModelSpec("elastic_net", {"alpha": 0.02, "l1_ratio": 0.5})), K, ("prediction",)),
    f"""WITH {TAME_SQL}, m AS (SELECT count(*) AS n, avg(mom) AS mx, avg(label) AS my, covar_pop(mom, label) AS c, var_pop(mom) AS v FROM train WHERE mom IS NOT NULL AND label IS NOT NULL), w AS (SELECT *, sign(c) * greatest(abs(c) - 0.01, 0.0) / (v + 0.01) AS w FROM m)
    SELECT ts_code, trade_date, {rounded_sql('my + w * (mom - mx)')} AS prediction FROM test, w""",
)
_STUMPS = "array(array(struct(0, 0.1D, 1, 2, true, false, 0D), struct(-1, 0D, -1, -1, false, true, -1D), struct(2, 0.5D, 3, 4, false, false, 0D), struct(-1, 0D, -1, -1, false, true, 2D), struct(-1, 0D, -1, -1, false, true, 3D)), array(struct(1, 0.3D, 1, 2, false, false, 0D), struct(-1, 0D, -1, -1, false, true, 0.25D), struct(-1, 0D, -1, -1, false, true, -0.5D)))"
register(
    "score_trees",
    lambda s, d: select_round(boosting.score_trees(tame(s, d), s.range(1).select(F.lit(0.5).alias("baseline"), F.lit(2).alias("depth"), F.expr(_STUMPS).cast(boosting.MODEL.split("trees ")[1]).alias("trees")), COLS), K, ("prediction",)),
    f"""WITH {TAME_SQL} SELECT ts_code, trade_date, {rounded_sql("0.5 + CASE WHEN mom IS NULL OR mom <= 0.1 THEN -1.0 WHEN surge IS NOT NULL AND surge <= 0.5 THEN 2.0 ELSE 3.0 END + CASE WHEN vola IS NOT NULL AND vola <= 0.3 THEN 0.25 ELSE -0.5 END")} AS prediction FROM tame""",
)
_BASIS = [linear.Term("power", "mom"), linear.Term("power", "vola", degree=3), linear.Term("product", "mom", "surge"), linear.Term("slog", "surge"), linear.Term("sexp", "mom")]
register(
    "score_basis",
    lambda s, d: select_round(linear.score_terms(tame(s, d), s.createDataFrame([(0.01, [0.5, -0.25, 0.125, 0.3, -0.2])], "intercept double, coefficients array<double>"), _BASIS, []), K, ("prediction",)),
    f"WITH {TAME_SQL} SELECT ts_code, trade_date, {rounded_sql('0.01 + 0.5 * mom - 0.25 * vola * vola * vola + 0.125 * mom * surge + 0.3 * sign(surge) * ln(1 + abs(surge)) - 0.2 * sign(mom) * (exp(least(abs(mom), 3.0)) - 1)')} AS prediction FROM tame",
)
_TERMS = ("mom_p1", "mom_p2", "mom_p3", "mom_slog", "mom_sexp")
register(
    "transformed_basis",
    lambda s, d: select_round(models.transformed_basis(samples(s, d).withColumn("mom", F.col("mom") * 3), ["mom"]), K, _TERMS, 4),
    f"""WITH {SAMPLES_SQL}, t AS (SELECT *, x AS mom_p1, x ** 2 AS mom_p2, x ** 3 AS mom_p3, sign(x) * ln(1 + abs(x)) AS mom_slog, CASE WHEN abs(x) > 3 THEN sign(x) * (exp(3.0) - 1) ELSE sign(x) * (exp(abs(x)) - 1) END AS mom_sexp FROM (SELECT ts_code, trade_date, mom * 3 AS x FROM samples)) SELECT ts_code, trade_date, {round_sql(_TERMS, 4)} FROM t""",
)
_LV = ("level", "expected_return", "expected_price")
register(
    "restore_levels",
    lambda s, d: select_round(models.restore_levels(labels.asset_price_labels(samples(s, d), 2).withColumn("prediction", F.col("mom") * 0.1)), K, _LV),
    f"WITH {SAMPLES_SQL}, t AS (SELECT ts_code, trade_date, close + abs(close) * (mom * 0.1) AS level, (mom * 0.1) * abs(close) / close AS expected_return, close * (1 + (mom * 0.1) * abs(close) / close) AS expected_price FROM samples) SELECT ts_code, trade_date, {round_sql(_LV)} FROM t",
)


def _effect(s: SparkSession, d: str) -> DataFrame:
    train = split(s, d)[0]
    fits = models.ridge_fits(train, _TWO, "label", 10.0, [])
    return models.state_effect(train.filter("surge IS NOT NULL AND mom IS NOT NULL"), fits, _TWO, "mom", []).select("n", rounded("effect", 5).alias("effect"))


register(
    "state_effect",
    _effect,
    f"WITH {TAME_SQL}, {_POOLED}, q AS (SELECT quantile_cont(mom, 0.75) - quantile_cont(mom, 0.25) AS q, least(count(mom), 128) AS n_rows FROM train WHERE surge IS NOT NULL AND mom IS NOT NULL) SELECT q.n_rows AS n, {rounded_sql('w1 * q.q', 5)} AS effect FROM q, fits",
)

register("holdout_split", lambda s, d: validation.holdout_split(sessions(s, d), 0.2), f"WITH {_P} SELECT trade_date, session_index >= floor(count(*) OVER () * 0.8) AS is_holdout FROM calendar")
register("holdout_split_dated", lambda s, d: validation.holdout_split(sessions(s, d), test_start="2000-01-01"), f"WITH {_P} SELECT trade_date, trade_date >= DATE '2000-01-01' AS is_holdout FROM calendar")
FOLDS_SQL = "folds AS (SELECT least(floor((i - 90) / floor((n - 90) / 3)), 2)::INT AS fold, min(trade_date) AS test_start, max(trade_date) AS test_end, count(*) AS n_sessions FROM (SELECT trade_date, session_index AS i, count(*) OVER () AS n FROM calendar) WHERE i >= 90 GROUP BY 1)"


def folds(s: SparkSession, d: str) -> DataFrame:
    return validation.expanding_folds(sessions(s, d), 3, 90)


register("expanding_folds", folds, f"WITH {_P}, {FOLDS_SQL} SELECT * FROM folds")
register(
    "purge_overlap",
    lambda s, d: validation.purge_counts(samples(s, d), folds(s, d)),
    f"WITH {SAMPLES_SQL}, {FOLDS_SQL} SELECT fold, CASE WHEN trade_date >= test_start THEN 'test' WHEN label_end < test_start THEN 'train' ELSE 'purged' END AS role, count(*) AS n_rows FROM samples JOIN folds ON trade_date <= test_end GROUP BY ALL",
)
register(
    "train_window",
    lambda s, d: validation.train_window(samples(s, d), CUT, 12).select(*K),
    f"WITH {SAMPLES_SQL}, m AS (SELECT * FROM samples WHERE trade_date < DATE '{CUT}' AND label_end < DATE '{CUT}') SELECT ts_code, trade_date FROM m WHERE trade_date IN (SELECT DISTINCT trade_date FROM m ORDER BY 1 DESC LIMIT 12)",
)
_SPECS = [ModelSpec("no_change"), ModelSpec("historical_drift"), ModelSpec("ridge", {"alpha": 10.0}), ModelSpec("per_target_ridge", {"alpha": 10.0}), ModelSpec("elastic_net", {"alpha": 1e-3, "l1_ratio": 0.5})]
_LINEAR = [*_SPECS, ModelSpec("ridge", {"alpha": 1.0}), *[ModelSpec(k, p) for k, p in (("polynomial_ridge", {"alpha": 10.0}), ("polynomial_elastic_net", _NET), ("transformed_ridge", {"alpha": 10.0}), ("factorwise_basis", _NET))]]
register("cross_validate", lambda s, d: models.cross_validate(kept(s, d), COLS, "label", [*_LINEAR, ModelSpec("gradient_boosting", {"rounds": 4})], models.folds_of(folds(s, d))))
register("nested_selection", lambda s, d: models.nested_selection(kept(s, d), COLS, "label", _LINEAR, models.folds_of(folds(s, d))))
_THREE = [ModelSpec("no_change"), ModelSpec("historical_drift"), ModelSpec("ridge", {"alpha": 10.0})]
register(
    "cross_validate_linear",
    lambda s, d: select_round(models.cross_validate(kept(s, d), _TWO, "label", _THREE, models.folds_of(folds(s, d))), ("id", "fold", "status"), ("score",), 5),
    f"""WITH {SAMPLES_SQL}, {FOLDS_SQL}, tame AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, -2.0), 2.0) END AS {c}' for c in [*COLS, 'label'])}) FROM samples),
    whole AS (SELECT * FROM tame WHERE mom IS NOT NULL AND surge IS NOT NULL AND label IS NOT NULL), train AS (SELECT w.*, fold FROM whole w JOIN folds ON label_end < test_start), {_SOLVE.format(g="fold,", a="10", by="GROUP BY fold")},
    told AS (SELECT fold, trade_date, label, w0 + w1 * mom + w2 * surge AS ridge, m0 AS drift FROM whole JOIN folds f ON trade_date BETWEEN test_start AND test_end JOIN fits USING (fold)),
    daily AS (SELECT fold, trade_date, avg((ridge - label) ** 2) AS r, avg((drift - label) ** 2) AS d, avg(label ** 2) AS z FROM told GROUP BY ALL), t AS (SELECT fold, unnest(['ridge:alpha=10.0', 'historical_drift', 'no_change']) AS id, unnest([avg(r), avg(d), avg(z)]) AS score FROM daily GROUP BY 1)
    SELECT id, fold, 'valid' AS status, {rounded_sql('score', 5)} AS score FROM t""",
)
register("freeze_candidates", lambda s, d: models.freeze_candidates(split(s, d)[0], COLS, "label", _LINEAR))
TRIALS_SQL = "trials AS (SELECT industry AS id, avg(s_acctbal) AS score, stddev_samp(s_acctbal) / sqrt(count(*)) AS se, count(*) AS complexity, CASE WHEN count(*) > 1 THEN 'valid' ELSE 'failed' END AS status, min(s_suppkey) AS place FROM (SELECT *, 'I' || s_nationkey % 7 AS industry FROM supplier) GROUP BY 1)"


def _trials(s: SparkSession, d: str) -> DataFrame:
    from ..sources.adapter import table

    rows = table(s, d, "supplier").withColumn("id", F.concat(F.lit("I"), (F.col("s_nationkey") % 7).cast("string")))
    return rows.groupBy("id").agg(F.avg("s_acctbal").alias("score"), (F.stddev_samp("s_acctbal") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("complexity"), F.when(F.count("*") > 1, "valid").otherwise("failed").alias("status"), F.min("s_suppkey").alias("place"))


_TC = ("id", "complexity", "status", "place")
register(
    "one_se_rule",
    lambda s, d: select_round(validation.one_se_rule(_trials(s, d)), _TC, ("score", "se"), 4),
    f"WITH {TRIALS_SQL}, v AS (SELECT * FROM trials WHERE status = 'valid'), b AS (SELECT score + coalesce(se, 0) AS edge FROM v ORDER BY score, complexity, id LIMIT 1) SELECT id, complexity, status, place, {round_sql(('score', 'se'), 4)} FROM v, b WHERE score <= edge ORDER BY complexity, id LIMIT 1",
)
register(
    "best_ic_choice",
    lambda s, d: select_round(validation.best_ic_choice(_trials(s, d).withColumn("status", F.lit("complete"))), _TC, ("score",), 4),
    f"WITH {TRIALS_SQL} SELECT id, complexity, 'complete' AS status, place, {rounded_sql('score', 4)} AS score FROM trials ORDER BY trials.score DESC, place LIMIT 1",
)
register("refit_dates", lambda s, d: validation.refit_dates(sessions(s, d), CUT, 7), f"WITH {_P}, t AS (SELECT trade_date, floor((row_number() OVER (ORDER BY trade_date) - 1) / 7) AS b FROM calendar WHERE trade_date >= DATE '{CUT}') SELECT trade_date, min(trade_date) OVER (PARTITION BY b) AS refit_date FROM t")
register("sequential_refit_forecast", lambda s, d: models.sequential_refit_forecast(kept(s, d), COLS, "label", validation.refit_dates(sessions(s, d), CUT, 13), 1.0, 60).select(*K, "refit_date", "status", "prediction"))
_FR = ("expected_entry", "expected_exit", "realized_entry", "realized_exit", "edge", "expected_change", "bps", "error")
_ROWS = f"""{FORECASTS_SQL}, rows_ AS (SELECT f.*, close AS state, abs(close) AS scale FROM forecasts f JOIN grid USING (ts_code, trade_date)), levels AS (SELECT *, state + scale * p_in AS expected_entry, state + scale * p_out AS expected_exit, state + scale * a_in AS realized_entry, state + scale * a_out AS realized_exit FROM rows_),
forecast_rows AS (SELECT *, sha256(trade_date::VARCHAR || '|' || ts_code || '|fit') AS id, expected_exit - expected_entry AS edge, p_out AS expected_change, (p_out - p_in) * 10000 AS bps, expected_exit - realized_exit AS error,
  CASE WHEN state IS NULL THEN 'invalid' WHEN p_out IS NULL THEN 'no_model' WHEN realized_exit IS NULL THEN 'open' ELSE 'matured' END AS status FROM levels)"""
ROWS_SQL = _ROWS


def forecast_table(s: SparkSession, d: str) -> DataFrame:
    close = samples(s, d).select(*K, F.col("close").alias("state"), F.abs("close").alias("scale"))
    return validation.forecast_rows(forecasts(s, d).join(close, list(K)))


register("forecast_rows", lambda s, d: select_round(forecast_table(s, d), (*K, "id", "status"), _FR, 5), f"WITH {_ROWS} SELECT ts_code, trade_date, id, status, {round_sql(_FR, 5)} FROM forecast_rows")
register(
    "training_plot_sample",
    lambda s, d: validation.training_plot_sample(samples(s, d), 9).select(*K),
    f"WITH {_P} SELECT ts_code, trade_date FROM (SELECT *, count(*) OVER (PARTITION BY ts_code) AS n FROM grid) WHERE session_index IN (SELECT floor(j * (n - 1) / 8.0 + 0.5) FROM range(9) r(j))",
)


def _errors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = forecasts(s, d).withColumn("error", F.col("p_out") - F.col("a_out")).filter("error IS NOT NULL")
    return rows.filter(number() % 5 != 0), rows.filter(number() % 3 != 0).withColumn("error", F.col("error") * 1.5)


register(
    "factor_increment",
    lambda s, d: select_round(validation.factor_increment(*_errors(s, d)), ("trade_date", "matched", "with_factors", "without"), ("mse_with", "mse_without"), 4),
    f"""WITH {FORECASTS_SQL}, e AS (SELECT trade_date, p_out - a_out AS e, substr(ts_code, 2)::BIGINT % 5 <> 0 AS a, substr(ts_code, 2)::BIGINT % 3 <> 0 AS b FROM forecasts WHERE p_out - a_out IS NOT NULL),
    t AS (SELECT trade_date, count(*) FILTER (a AND b) AS matched, count(*) FILTER (a) AS with_factors, count(*) FILTER (b) AS without, avg(e * e) FILTER (a AND b) AS mse_with, avg(e * 1.5 * e * 1.5) FILTER (a AND b) AS mse_without FROM e WHERE a OR b GROUP BY 1) SELECT trade_date, matched, with_factors, without, {round_sql(('mse_with', 'mse_without'), 4)} FROM t""",
)
register("drop_correlated_pairs", lambda s, d: select_round(preprocess.pair_correlations(samples(s, d), COLS), ("a", "b", "n"), ("corr",)), f"WITH {SAMPLES_SQL}, t AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count({a} + {b}) AS n, corr({a}, {b}) AS corr FROM samples" for a, b in (("mom", "vola"), ("mom", "surge"), ("vola", "surge"))) + f") SELECT a, b, n, {rounded_sql('corr')} AS corr FROM t")
