"""Queries of labels, targets, state features and train-fold preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..operators import labels, preprocess
from ..sources import adapter
from ..sources.shared import cut
from .factor_queries import grid_of
from .registry import register, rounded, rounded_sql
from .source_queries import number, round_sql, select_round

P, T = adapter.PANEL_SQL, adapter.TARGETS_SQL
K = ("ts_code", "trade_date")
W = "(PARTITION BY ts_code ORDER BY trade_date)"
LABEL_SQL = f"labelled AS (SELECT *, lead(open, 3) OVER {W} / lead(open, 1) OVER {W} - 1 AS label FROM grid)"
register("forward_return", lambda s, d: select_round(labels.forward_return(grid_of(s, d), 2), K, ("label",)), f"WITH {P}, {LABEL_SQL} SELECT ts_code, trade_date, {rounded_sql('label')} AS label FROM labelled")
register(
    "forward_excess_return",
    lambda s, d: select_round(labels.forward_excess_return(grid_of(s, d), 2), K, ("label",)),
    f"WITH {P}, {LABEL_SQL} SELECT ts_code, trade_date, {rounded_sql('label - avg(label) OVER (PARTITION BY trade_date)')} AS label FROM labelled",
)


def sessions(s: SparkSession, d: str) -> DataFrame:
    return adapter.calendar(adapter.panel(s, d))


ENDS_SQL = "ends AS (SELECT trade_date, session_index, lead(trade_date, 3) OVER (ORDER BY trade_date) AS label_end FROM calendar)"
register("label_end_date", lambda s, d: labels.label_end_date(sessions(s, d), sessions(s, d), 2).select("trade_date", "label_end"), f"WITH {P}, {ENDS_SQL} SELECT trade_date, label_end FROM ends")
FEATURES = {"mom": f.returns(f.field("close"), 5), "vola": f.ts_std(f.returns(f.field("close"), 1), 5), "surge": f.field("vol") / f.ts_mean(f.field("vol"), 5) - 1}


def samples(s: SparkSession, d: str) -> DataFrame:
    """Features and a two-session label for every cell, with the label's end."""
    made = labels.forward_return(f.evaluate(grid_of(s, d), FEATURES), 2)
    return labels.sample_valid(labels.label_end_date(made, sessions(s, d), 2), list(FEATURES))


SAMPLES_SQL = f"""{P}, {LABEL_SQL}, {f.factor_sql(FEATURES, 'labelled', 'featured')}, {ENDS_SQL}, samples AS (SELECT x.*, label_end, coalesce(mom, vola, surge) IS NOT NULL AND label IS NOT NULL AND close IS NOT NULL AS valid FROM featured x JOIN ends USING (trade_date))"""
register("sample_valid", lambda s, d: samples(s, d).select(*K, "valid"), f"WITH {SAMPLES_SQL} SELECT ts_code, trade_date, valid FROM samples")
register("observation_sampling", lambda s, d: labels.observation_sampling(grid_of(s, d), 4, 10).select(*K, "session_index"), f"WITH {P} SELECT ts_code, trade_date, session_index FROM grid WHERE session_index >= 10 AND (session_index - 10) % 4 = 0")
_V = ("state", "scale", "entry", "exit")
register(
    "asset_price_labels",
    lambda s, d: select_round(labels.asset_price_labels(grid_of(s, d), 2), K, _V),
    f"WITH {P}, t AS (SELECT ts_code, trade_date, close AS state, abs(close) AS scale, (lead(open, 1) OVER {W} - close) / abs(close) AS entry, (lead(open, 3) OVER {W} - close) / abs(close) AS exit FROM grid) SELECT ts_code, trade_date, {round_sql(_V)} FROM t",
)
_TK = ("target_id", "trade_date")
_SIZED = f"{T}, sized AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS n_legs FROM targets)"
STATE_SQL = f"""{_SIZED}, whole AS (SELECT *, count(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 8 AS whole FROM grid),
states AS (SELECT target_id, trade_date, CASE WHEN ok THEN v END AS state, CASE WHEN ok THEN a END AS gross FROM (SELECT target_id, trade_date, count(*) FILTER (whole AND close IS NOT NULL) = max(n_legs) AS ok, sum(quantity * close) AS v, sum(abs(quantity * close)) AS a FROM whole JOIN sized USING (ts_code) GROUP BY ALL))"""
register("basket_state", lambda s, d: select_round(labels.basket_state(grid_of(s, d), adapter.targets(s, d), 8), _TK, ("state", "gross")), f"WITH {P}, {STATE_SQL} SELECT target_id, trade_date, {round_sql(('state', 'gross'))} FROM states")
_BV = ("state", "gross", "entry", "exit")
register(
    "basket_labels",
    lambda s, d: select_round(labels.basket_labels(grid_of(s, d), adapter.targets(s, d), 2), _TK, _BV),
    f"""WITH {P}, {_SIZED}, moved AS (SELECT *, lead(open, 1) OVER {W} AS i, lead(open, 3) OVER {W} AS o FROM grid), t AS (SELECT target_id, trade_date, CASE WHEN count(close) = max(n_legs) THEN sum(quantity * close) END AS state, CASE WHEN count(close) = max(n_legs) THEN sum(abs(quantity * close)) END AS gross,
    CASE WHEN count(i) = max(n_legs) THEN sum(quantity * i) END AS i, CASE WHEN count(o) = max(n_legs) THEN sum(quantity * o) END AS o FROM moved JOIN sized USING (ts_code) GROUP BY ALL), u AS (SELECT target_id, trade_date, state, gross, (i - state) / gross AS entry, (o - state) / gross AS exit FROM t)
    SELECT target_id, trade_date, {round_sql(_BV)} FROM u""",
)
register(
    "fixed_basket",
    lambda s, d: labels.basket_factor(grid_of(s, d), labels.fixed_basket(s, "B", {"S1": 1.0, "S2": -0.5, "S3": 2.0}), "vol").select(*_TK, rounded("factor").alias("factor")),
    f"""WITH {P}, t AS (SELECT trade_date, CASE WHEN count(close) = 3 THEN sum(q * close * vol) / sum(abs(q * close)) END AS factor FROM grid JOIN (VALUES ('S1', 1.0), ('S2', -0.5), ('S3', 2.0)) b(ts_code, q) USING (ts_code) GROUP BY 1) SELECT 'B' AS target_id, trade_date, {rounded_sql('factor')} AS factor FROM t""",
)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    own = adapter.targets(s, d)
    return own.groupBy(F.col("target_id").alias("pair_id")).agg(F.max(F.when(F.col("quantity") > 0, F.col("ts_code"))).alias("first"), F.max(F.when(F.col("quantity") < 0, F.col("ts_code"))).alias("second")).filter("first IS NOT NULL AND second IS NOT NULL")


register(
    "pair_ols_basket",
    lambda s, d: select_round(labels.pair_ols_basket(grid_of(s, d), _pairs(s, d), 10), ("pair_id", "trade_date"), ("beta",)),
    f"""WITH {P}, {T}, pairs AS (SELECT target_id AS pair_id, max(CASE WHEN quantity > 0 THEN ts_code END) AS a, max(CASE WHEN quantity < 0 THEN ts_code END) AS b FROM targets GROUP BY 1),
    j AS (SELECT pair_id, g.trade_date, g.close AS y, h.close AS x FROM pairs JOIN grid g ON g.ts_code = a JOIN grid h ON h.ts_code = b AND h.trade_date = g.trade_date),
    w AS (SELECT pair_id, trade_date, count(x + y) OVER q AS n, var_pop(x) OVER q AS v, covar_pop(x, y) OVER q AS c FROM j WINDOW q AS (PARTITION BY pair_id ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT pair_id, trade_date, {rounded_sql('CASE WHEN n = 10 AND v > 1e-12 THEN c / v END')} AS beta FROM w""",
)
for _mode, _x in (("forecast", f"lead(close, 3) OVER {W} / close - 1"), ("association", f"close / lag(close, 3) OVER {W} - 1")):
    register(
        f"asset_return_{_mode}",
        lambda s, d, m=_mode: select_round(labels.asset_return_response(grid_of(s, d), 3, m), K, ("response",)),
        f"WITH {P}, t AS (SELECT ts_code, trade_date, {_x} AS response FROM grid) SELECT ts_code, trade_date, {rounded_sql('response')} AS response FROM t",
    )
_SCALE_SQL = f"r AS (SELECT *, close / lag(close) OVER {W} - 1 AS r FROM grid), w AS (SELECT *, count(r) OVER q AS n, stddev_samp(r) OVER q AS sd FROM r WINDOW q AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), scaled AS (SELECT *, CASE WHEN n = 5 AND sd > 1e-8 THEN sd * sqrt(3.0) END AS scale FROM w)"
register("response_scale", lambda s, d: select_round(labels.response_scale(grid_of(s, d), 5, 3), K, ("scale",)), f"WITH {P}, {_SCALE_SQL} SELECT ts_code, trade_date, {rounded_sql('scale')} AS scale FROM scaled")
register(
    "response_scale_association",
    lambda s, d: select_round(labels.response_scale(grid_of(s, d), 5, 3, "association"), K, ("scale",)),
    f"WITH {P}, {_SCALE_SQL}, t AS (SELECT ts_code, trade_date, lag(scale, 3) OVER {W} AS scale FROM scaled) SELECT ts_code, trade_date, {rounded_sql('scale')} AS scale FROM t",
)


def _judged(s: SparkSession, d: str, mode: str, family: str) -> DataFrame:
    made = f.evaluate(grid_of(s, d), {"mom": f.returns(f.field("close"), 9)})
    rows = labels.response_scale(made, 5, 3, mode).withColumns({"event": F.when(F.col("vol") > 60, 1.0).otherwise(0.0), "report": F.when(number() % 4 != 1, F.col("mom"))})
    return labels.invalid_reason(rows, ["mom", "report"], 3, mode, family, ["event"], ["report"]).select(*K, "reason")


for _mode, _family, _start, _more in (
    ("forecast", "event", "close", "WHEN NOT coalesce(vol > 60, false) THEN 'no_observed_event'"),
    ("forecast", "ridge", "close", ""),
    ("forecast", "fundamental", "close", "WHEN substr(ts_code, 2)::BIGINT % 4 = 1 OR mom IS NULL THEN 'no_observed_fundamental_predictor'"),
    ("association", "ridge", "past", ""),
):
    _scale = "scale" if _mode == "forecast" else "past_scale"
    register(
        "invalid_reason" if _family == "event" else f"invalid_reason_{_mode}_{_family}",
        lambda s, d, m=_mode, x=_family: _judged(s, d, m, x),
        f"""WITH {P}, {_SCALE_SQL}, t AS (SELECT *, close / lag(close, 9) OVER {W} - 1 AS mom, lag(close, 3) OVER {W} AS past, lag(scale, 3) OVER {W} AS past_scale FROM scaled) SELECT ts_code, trade_date,
        CASE {"WHEN session_index < 3 THEN 'response_window_warmup'" if _mode == "association" else ""} WHEN {_start} IS NULL THEN 'missing_origin_price' WHEN {_scale} IS NULL THEN 'response_normalizer_unavailable'
        WHEN close IS NULL OR mom IS NULL THEN 'no_observed_factor_input' {_more} END AS reason FROM t""",
    )
for _k, _x in ((2, "lead"), (-2, "lag")):
    register(f"input_offset_{_x}", lambda s, d, k=_k: labels.input_offset(grid_of(s, d), "vol", k).select(*K, "vol"), f"WITH {P} SELECT ts_code, trade_date, {_x}(vol, 2) OVER {W} AS vol FROM grid")


def _inputs(s: SparkSession, d: str) -> DataFrame:
    rows = labels.label_end_date(grid_of(s, d), sessions(s, d), 2)
    made = rows.withColumns({"a__available_date": F.when(F.col("close").isNotNull(), F.date_add("trade_date", (number() % 3 - 1).cast("int"))), "b__available_date": F.col("trade_date"), "verified": number() % 4 != 2})
    return labels.availability_class(labels.input_availability(made, ["a", "b"]).withColumn("available_at", F.when(F.col("a__available_date").isNotNull(), F.col("available_at"))))


_INPUTS = f"{P}, {ENDS_SQL}, t AS (SELECT ts_code, trade_date, label_end, substr(ts_code, 2)::BIGINT AS n, CASE WHEN close IS NOT NULL THEN trade_date + (n % 3 - 1)::INT END AS a, trade_date AS b FROM grid JOIN ends USING (trade_date)), u AS (SELECT *, CASE WHEN a IS NOT NULL THEN greatest(a, b) END AS available_at, greatest(a, b, label_end) AS ready_at FROM t)"
register("input_availability", lambda s, d: _inputs(s, d).select(*K, "available_at", "ready_at", F.try_element_at("evidence", F.lit("a")).alias("a_date")), f"WITH {_INPUTS} SELECT ts_code, trade_date, available_at, ready_at, a::VARCHAR AS a_date FROM u")
CLASS_SQL = "CASE WHEN available_at IS NULL THEN 'unresolved' WHEN n % 4 = 2 THEN 'unverified' WHEN available_at <= trade_date THEN 'origin_known' ELSE 'conditional_realised' END"
register("availability_class", lambda s, d: _inputs(s, d).select(*K, "availability_class"), f"WITH {_INPUTS} SELECT ts_code, trade_date, {CLASS_SQL} AS availability_class FROM u")
register("availability_counts", lambda s, d: _inputs(s, d).groupBy("availability_class").agg(F.count("*").alias("n_rows")), f"WITH {_INPUTS} SELECT {CLASS_SQL} AS availability_class, count(*) AS n_rows FROM u GROUP BY 1")
register(
    "pair_valuation",
    lambda s, d: select_round(labels.pair_valuation(grid_of(s, d), adapter.targets(s, d), sessions(s, d).unionByName(sessions(s, d).withColumn("trade_date", F.date_add("trade_date", 1))).select("trade_date").distinct()), (*_TK, "status"), ("value",)),
    f"""WITH {P}, {_SIZED}, dates AS (SELECT trade_date FROM calendar UNION SELECT trade_date + 1 FROM calendar), v AS (SELECT target_id, trade_date, count(close) AS n, max(n_legs) AS n_legs, sum(quantity * close) AS v FROM grid JOIN sized USING (ts_code) GROUP BY ALL),
    t AS (SELECT i.target_id, d.trade_date, CASE WHEN n IS NULL THEN 'outside_calendar' WHEN n < n_legs THEN 'missing_legs' ELSE 'complete' END AS status, v FROM (SELECT DISTINCT target_id FROM targets) i CROSS JOIN dates d LEFT JOIN v ON v.target_id = i.target_id AND v.trade_date = d.trade_date) SELECT target_id, trade_date, status, {rounded_sql("CASE WHEN status = 'complete' THEN v END")} AS value FROM t""",
)
register("label_is_mature", lambda s, d: labels.label_is_mature(samples(s, d), "1999-01-01").select(*K, "mature"), f"WITH {SAMPLES_SQL} SELECT ts_code, trade_date, coalesce(trade_date < DATE '1999-01-01' AND label_end < DATE '1999-01-01' AND label IS NOT NULL, false) AS mature FROM samples")


def _away(n: int) -> str:
    return f"(close - CASE WHEN count(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END) / abs(close)"


_CHANGE = f"(close - lag(close, {{n}}) OVER {W}) / abs(close)"
for _kind, _made in {
    "reversion": {"away20": _away(20), "away60": _away(60), "change1": _CHANGE.format(n=1)},
    "trend": {f"change{n}": _CHANGE.format(n=n) for n in (1, 5, 20, 60)},
    "other": {f"change{n}": _CHANGE.format(n=n) for n in (1, 5)},
}.items():
    register(
        f"state_features_{_kind}",
        lambda s, d, k=_kind, c=tuple(_made): select_round(labels.state_features(grid_of(s, d), k), K, c),
        f"WITH {P}, t AS (SELECT ts_code, trade_date, {', '.join(f'{x} AS {c}' for c, x in _made.items())} FROM grid) SELECT ts_code, trade_date, {round_sql(tuple(_made))} FROM t",
    )
register(
    "volatility20",
    lambda s, d: select_round(labels.volatility20(grid_of(s, d)), K, ("volatility20",)),
    f"""WITH {P}, t AS (SELECT *, close - lag(close) OVER {W} AS x FROM grid), w AS (SELECT *, count(x) OVER q AS n, stddev_samp(x) OVER q AS sd FROM t WINDOW q AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT ts_code, trade_date, {rounded_sql('CASE WHEN n = 20 THEN sd / abs(close) END')} AS volatility20 FROM w""",
)
register(
    "basket_factor",
    lambda s, d: select_round(labels.basket_factor(grid_of(s, d), adapter.targets(s, d), "vol"), _TK, ("factor",)),
    f"WITH {P}, {_SIZED}, t AS (SELECT target_id, trade_date, CASE WHEN count(close) = max(n_legs) THEN sum(quantity * close * vol) / sum(abs(quantity * close)) END AS factor FROM grid JOIN sized USING (ts_code) GROUP BY ALL) SELECT target_id, trade_date, {rounded_sql('factor')} AS factor FROM t",
)
register(
    "event_flag",
    lambda s, d: labels.event_flag(grid_of(s, d).withColumn("e", F.when(F.col("vol") > 150, F.lit(1.0)).otherwise(0.0)), adapter.targets(s, d), ["e"]),
    f"WITH {P}, {T} SELECT target_id, trade_date, max(CASE WHEN vol > 150 THEN 1 ELSE 0 END) = 1 AS event FROM grid JOIN targets USING (ts_code) GROUP BY ALL",
)
register(
    "origin_domain",
    lambda s, d: labels.origin_domain(sessions(s, d), adapter.targets(s, d), 2),
    f"WITH {P}, {T} SELECT target_id, trade_date, entry_date, exit_date FROM (SELECT DISTINCT target_id FROM targets) CROSS JOIN (SELECT trade_date, lead(trade_date, 1) OVER (ORDER BY trade_date) AS entry_date, lead(trade_date, 3) OVER (ORDER BY trade_date) AS exit_date FROM calendar)",
)
register(
    "rolling_refit_schedule",
    lambda s, d: sessions(s, d).withColumn("fit_index", F.floor(F.col("session_index") / 12)).withColumn("fit_date", F.min("trade_date").over(labels.Window.partitionBy("fit_index"))).select("trade_date", "fit_index", "fit_date"),
    f"WITH {P} SELECT trade_date, floor(session_index / 12)::BIGINT AS fit_index, min(trade_date) OVER (PARTITION BY floor(session_index / 12)) AS fit_date FROM calendar",
)

COLS = list(FEATURES)


TRAIN = "trade_date < DATE '1999-01-01'"


def train(s: SparkSession, d: str) -> DataFrame:
    return samples(s, d).filter(TRAIN)


def _applied(s: SparkSession, d: str, fit, apply) -> DataFrame:
    """Rows are made once: they are fitted and then transformed."""
    rows = cut(samples(s, d).select(*K, *COLS))
    return select_round(apply(rows, fit(rows.filter(TRAIN), COLS), COLS), K, tuple(COLS), 5)


def _stats(*parts: str) -> str:
    return f"train AS (SELECT * FROM samples WHERE trade_date < DATE '1999-01-01'), stats AS (SELECT {', '.join(parts)} FROM train)"


def _out(expr: str) -> str:
    return ", ".join(f"{rounded_sql(expr.format(c=c), 5)} AS {c}" for c in COLS)


_LOHI = [x for c in COLS for x in (f"quantile_cont({c}, 0.01) AS {c}_lo", f"quantile_cont({c}, 0.99) AS {c}_hi")]
register("fold_winsorize", lambda s, d: _applied(s, d, preprocess.winsor_bounds, preprocess.winsorize), f"WITH {SAMPLES_SQL}, {_stats(*_LOHI)} SELECT ts_code, trade_date, {_out('CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END')} FROM samples, stats")
register("fold_impute_median", lambda s, d: _applied(s, d, preprocess.medians, preprocess.impute), f"WITH {SAMPLES_SQL}, {_stats(*[f'quantile_cont({c}, 0.5) AS {c}_med' for c in COLS])} SELECT ts_code, trade_date, {_out('coalesce({c}, {c}_med)')} FROM samples, stats")
register("fold_standardize", lambda s, d: _applied(s, d, preprocess.moments, preprocess.standardize), f"WITH {SAMPLES_SQL}, {_stats(*[f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in COLS])} SELECT ts_code, trade_date, {_out('({c} - {c}_m) / {c}_s')} FROM samples, stats")
_MIDS = [f"quantile_cont({c}, 0.5) AS {c}_mid, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr" for c in COLS]
register("fold_robust_scale", lambda s, d: _applied(s, d, preprocess.robust_stats, preprocess.robust_scale), f"WITH {SAMPLES_SQL}, {_stats(*_MIDS)} SELECT ts_code, trade_date, {_out('({c} - {c}_mid) / {c}_iqr')} FROM samples, stats")
register(
    "fold_global_population",
    lambda s, d: preprocess.global_population(train(s, d), ["session_index"]).agg(F.avg("session_index").alias("mean"), F.count("*").alias("n")),
    f"WITH {SAMPLES_SQL} SELECT avg(x) AS mean, count(*) AS n FROM (SELECT max(session_index) AS x FROM samples WHERE trade_date < DATE '1999-01-01' GROUP BY trade_date)",
)
register(
    "fold_min_observations",
    lambda s, d: preprocess.min_observations(samples(s, d), COLS, 15_000),
    f"WITH {SAMPLES_SQL}, t AS (SELECT count(mom) AS mom, count(vola) AS vola, count(surge) AS surge FROM samples) SELECT * FROM (UNPIVOT t ON mom, vola, surge INTO NAME feature VALUE n) WHERE n < 15000",
)
register(
    "fold_drop_correlated",
    lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(preprocess.drop_correlated(samples(s, d).withColumn("twice", F.col("mom") * 2 + 1), ["mom", "twice", "vola", "surge"]))], "place int, feature string"),
    f"""WITH {SAMPLES_SQL}, t AS (SELECT abs(corr(mom, mom * 2 + 1)) AS a, abs(corr(mom, vola)) AS b, abs(corr(mom, surge)) AS c, abs(corr(vola, surge)) AS e FROM samples),
    k AS (SELECT 'mom' AS feature, 0 AS p FROM t UNION ALL SELECT 'twice', 1 FROM t WHERE a < 0.95 UNION ALL SELECT 'vola', 2 FROM t WHERE b < 0.95 UNION ALL SELECT 'surge', 3 FROM t WHERE c < 0.95 AND (b >= 0.95 OR e < 0.95)) SELECT row_number() OVER (ORDER BY p) - 1 AS place, feature FROM k""",
)
_CLIP = "CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END"
register(
    "fold_transform",
    lambda s, d: _applied(s, d, preprocess.fit_fold_transform, preprocess.apply_fold_transform),
    f"""WITH {SAMPLES_SQL}, train AS (SELECT * FROM samples WHERE trade_date < DATE '1999-01-01'), b AS (SELECT {', '.join(_LOHI)} FROM train), c1 AS (SELECT {', '.join(f"{_CLIP.format(c=c)} AS {c}" for c in COLS)} FROM train, b),
    m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}_med' for c in COLS)} FROM c1), f AS (SELECT {', '.join(f'coalesce({c}, {c}_med) AS {c}' for c in COLS)} FROM c1, m), stats AS (SELECT {', '.join(_MIDS)} FROM f)
    SELECT ts_code, trade_date, {_out('(coalesce(' + _CLIP + ', {c}_med) - {c}_mid) / {c}_iqr')} FROM samples, b, m, stats""",
)
