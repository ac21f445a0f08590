"""Hand-made cases: golden factor values, causality, as-of edges, statements, models and portfolios."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake import plans
from factorlake.functions import factors as f
from factorlake.functions import recipes
from factorlake.operators import asof, context, metrics, models, quantiles, statements, universe, validation
from factorlake.sources import quality
from factorlake.streaming import bars

DAY0 = dt.date(2020, 1, 1)
DAYS = [DAY0 + dt.timedelta(days=i) for i in range(25)]


@pytest.fixture(scope="module")
def golden(spark):
    """25 sessions of two symbols: closes 100..124 and 200..248."""
    rows = [(c, d, float(k * (100 + i)), 5.0, 7.0) for c, k in (("A", 1), ("B", 2)) for i, d in enumerate(DAYS)]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, close double, vol double, ext_observation double")


def last_values(df, name):
    return [r[name] for r in df.filter(F.col("trade_date") == DAYS[-1]).orderBy("ts_code").collect()]


@pytest.mark.parametrize(
    "factor,expected,lookback",
    [
        (f.returns(f.field("close"), 4), [124 / 120 - 1] * 2, 4),
        (f.ts_mean(f.field("close"), 5), [122.0, 244.0], 4),
        (f.ts_std(f.field("close"), 5), [2**0.5, 2 * 2**0.5], 4),
        (f.ts_rank(f.field("close"), 5), [1.0, 1.0], 4),
        (f.ts_rank(f.field("vol"), 5), [0.6, 0.6], 4),
        (f.rank(f.field("close")), [0.5, 1.0], 0),
        (f.rank(f.field("vol")), [0.75, 0.75], 0),
        (f.zscore(f.field("close")), [-1.0, 1.0], 0),
        (f.zscore(f.field("vol")), [None, None], 0),
        (f.delta(f.field("close"), 3), [3.0, 6.0], 3),
        (1 / (f.field("vol") - 5), [None, None], 0),
        (f.log(-f.field("close")), [None, None], 0),
        (f.clip(f.field("close"), 0, 130), [124.0, 130.0], 0),
        (f.ts_sum(f.field("vol"), 25), [125.0, 125.0], 24),
        (f.lag(f.ts_max(f.field("close"), 3), 2), [122.0, 244.0], 4),
    ],
)
def test_golden_factors(golden, factor, expected, lookback):
    got = last_values(f.evaluate(golden, {"x": factor}), "x")
    assert [None if v is None else round(v, 9) for v in got] == [None if v is None else round(v, 9) for v in expected]
    assert factor.lookback == lookback


def test_windows_are_checked():
    for n in (0, 253):
        with pytest.raises(ValueError):
            f.ts_mean(f.field("close"), n)
    with pytest.raises(ValueError):
        f.clip(f.field("close"), 1, 1)
    assert len(recipes.all_recipes()) == len(recipes.PRICE_RECIPES) * 8 + 5 and len(recipes.daily_recipes()) == 12 * 5 + 18
    assert f.rank(f.field("a") + f.field("b")).fields == {"a", "b"}


def test_factors_do_not_see_the_future(spark, sf_dir):
    from factorlake.plans.factor_queries import grid_of

    grid = grid_of(spark, sf_dir).cache()
    made = {n: recipes.PRICE_RECIPES[n].build(5) for n in ("momentum", "illiquidity", "volume_rank", "money_flow", "breakout")} | {"cross": f.rank(f.ts_mean(f.zscore(f.field("close")), 3))}
    late = F.col("trade_date") > F.lit("1998-06-01").cast("date")
    changed = grid.withColumns({c: F.when(late, F.col(c) * 17).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "vol", "amount")})
    past = lambda df: f.evaluate(df, made).filter(~late).select("ts_code", "trade_date", *made)
    assert past(grid).exceptAll(past(changed)).count() == 0


def test_missing_sessions_are_not_bridged(spark, golden):
    gap = golden.withColumn("close", F.when((F.col("trade_date") != DAYS[20]) | (F.col("ts_code") != "A"), F.col("close")))
    got = last_values(f.evaluate(gap, {"mean": f.ts_mean(f.field("close"), 5), "ret": f.returns(f.field("close"), 4)}), "mean")
    assert got == [None, 244.0]
    assert last_values(f.evaluate(gap, {"ret": f.returns(f.field("close"), 4)}), "ret")[0] is None


def test_next_session_and_newest_period(spark):
    calendar = spark.createDataFrame([(d,) for d in DAYS[::2]], "trade_date date")
    grid = calendar.select(F.lit("A").alias("ts_code"), "trade_date")
    d = lambda i: DAY0 + dt.timedelta(days=i)
    rows = [("A", d(2), d(-10), 1.0), ("A", d(5), d(-5), 2.0), ("A", d(9), d(-10), 9.0), ("A", d(12), d(-1), None), ("A", d(30), d(0), 5.0), ("A", d(16), d(1), 3.0), ("A", d(16), d(1), 4.0)]
    reports = spark.createDataFrame(rows, "ts_code string, ann_date date, end_date date, x double")
    got = {r["trade_date"]: r["x"] for r in asof.join_reports_asof(grid, reports, ["x"], calendar).collect()}
    assert [got[d(i)] for i in (0, 2, 4, 6, 10, 12, 14, 16, 18, 24)] == [None, None, 1.0, 2.0, 2.0, 2.0, None, None, None, None]


def test_foreign_series_are_strictly_prior_and_fresh(spark):
    calendar = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    series = spark.createDataFrame([(DAYS[2], 1.0), (DAYS[5], None), (DAYS[6], 3.0)], "trade_date date, close double")
    got = {r["trade_date"]: (r["source_date"], r["close"]) for r in context.asof_strict_prior(calendar, series, ["close"]).collect()}
    assert got[DAYS[2]] == (None, None) and got[DAYS[3]] == (DAYS[2], 1.0) and got[DAYS[6]] == (DAYS[5], None)
    assert got[DAYS[7]] == (DAYS[6], 3.0) and got[DAYS[13]] == (DAYS[6], 3.0) and got[DAYS[14]] == (None, None)


def test_statement_states_by_hand(spark):
    """Two years of quarters of one company; every ratio is known."""
    ends = [dt.date(2019, 3, 31), dt.date(2019, 6, 30), dt.date(2019, 9, 30), dt.date(2019, 12, 31), dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)]
    rows = []
    for i, e in enumerate(ends):
        year, q = divmod(i, 4)
        grow = 1.2 if year else 1.0
        revenue = 100 * grow * (q + 1)
        flows = [revenue, revenue * 0.2, revenue * 0.12, revenue * 0.1, revenue * 0.15, revenue * 0.05]
        assets = 900.0 if i == 3 else 1100.0 if i == 7 else 1000.0
        points = [assets, assets * 0.4, assets * 0.6, assets * 0.2, assets * 0.1, assets * 0.05, assets * 0.02, assets * 0.04, assets * 0.06]
        rows.append(("A", e, e + dt.timedelta(days=20), None, "1", "CNY", *flows, *points))
    names = statements.FLOWS + statements.POINTS
    frame = spark.createDataFrame(rows, "ts_code string, end_date date, ann_date date, f_ann_date date, report_type string, unit string, " + ", ".join(f"{n} double" for n in names))
    calendar = spark.createDataFrame([(dt.date(2019, 1, 1) + dt.timedelta(days=i),) for i in range(800)], "trade_date date")
    facts = statements.normalize_facts(frame, calendar, names)
    dates = spark.createDataFrame([("A", dt.date(2021, 2, 1)), ("A", dt.date(2021, 1, 20))], "ts_code string, as_of date")
    got = {(r["as_of"], r["state"]): r["value"] for r in statements.state_ratios(facts, dates).collect()}
    want = {
        "revenue_quarter_yoy": 0.2, "revenue_ttm_yoy": 0.2, "operating_margin": 0.2, "parent_net_margin": 0.1, "cash_revenue_ratio": 0.15, "profit_cash_asset_gap": 480 * -0.03 / 1000, "cash_assets_ratio": 0.072, "capex_revenue_ratio": 0.05,
        "cash_less_capex_assets": 0.048, "assets_yoy": 2 / 9, "cash_asset_share": 0.1, "current_coverage": 3.0, "liability_asset_share": 0.4, "borrowings_asset_share": 0.1, "receivable_asset_share": 0.05, "goodwill_asset_share": 0.02,
    }
    assert {s: round(got[(dt.date(2021, 2, 1), s)], 9) for s in want} == {s: round(v, 9) for s, v in want.items()}
    assert round(got[(dt.date(2021, 1, 20), "assets_yoy")], 9) == 0.0  # the last year's end is known from the next session on


def test_exclusion_wins(spark):
    securities = spark.createDataFrame([("S1", "I1", "x", "E", "L"), ("S2", "I1", "x", "F", "L"), ("S3", "I2", "y", "E", "L")], "ts_code string, industry string, area string, exchange string, list_status string")
    members = spark.createDataFrame([("P", "S9"), ("P", "S3")], "universe_id string, ts_code string")
    pick = universe.Selection((universe.Group({"industry": ("I1",), "exchange": ("E",)}), universe.Group(pools=("P",))), ("S2",), (universe.Group({"area": ("y",)}),), ("S1",))
    assert sorted(r[0] for r in universe.resolve(securities, members, pick).collect()) == ["S2", "S9"]


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3))
    y = x @ [0.5, -1.0, 2.0] + 0.3 + rng.standard_normal(200) * 0.1
    rows = [("A" if i % 2 else "B", DAY0 + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, a double, b double, c double, y double")
    own = {r["ts_code"]: r for r in models.ridge_fits(df, ["a", "b", "c"], "y", 3.0, ["ts_code"]).collect()}
    for code, keep in (("A", np.arange(200) % 2 == 1), ("B", np.arange(200) % 2 == 0)):
        xc, yc = x[keep] - x[keep].mean(axis=0), y[keep] - y[keep].mean()
        w = np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ yc)
        assert np.allclose(own[code]["coefficients"], w) and np.isclose(own[code]["intercept"], y[keep].mean() - x[keep].mean(axis=0) @ w)
    wide = models.fit_predict(df, df, ["a", "b", "c"], "y", models.ModelSpec("ridge", {"alpha": 3.0}))
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ yc)
    got = np.array([r["prediction"] for r in wide.orderBy("trade_date").collect()])
    assert np.abs(got - (xc @ w + y.mean())).max() < 1e-6
    bayes = models.bayesian_ridge_fit(df, ["a", "b", "c"], "y").first()
    assert np.allclose(bayes["coefficients"], [0.5, -1, 2], atol=0.05) and 50 < bayes["alpha"] < 200
    for kind, params in {"elastic_net": {"alpha": 1e-3}, "huber": {}, "random_forest": {"trees": 8}, "gradient_boosting": {"rounds": 10, "rate": 0.3}}.items():
        made = models.fit_predict(df, df, ["a", "b", "c"], "y", models.ModelSpec(kind, params))
        pred = np.array([r["prediction"] for r in made.orderBy("trade_date").collect()])
        assert np.corrcoef(pred, y)[0, 1] > 0.8


def test_refits_use_matured_labels_only(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        a = rng.gauss(0, 1)
        rows.append(("A", DAY0 + dt.timedelta(days=i), a, 2 * a if i < 40 else -2 * a, DAY0 + dt.timedelta(days=i + 3), i))
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, a double, label double, label_end date, session_index int")
    schedule = validation.refit_dates(df.select("trade_date"), str(DAY0 + dt.timedelta(days=41)), 10)
    made = models.sequential_refit_forecast(df, ["a"], "label", schedule, 0.001, 30)
    first = made.filter("session_index < 51").collect()
    assert len(first) == 10 and all(abs(r["prediction"] - 2 * r["a"]) < 0.01 for r in first)
    assert made.count() == 39


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(5)
    daily = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.standard_normal(120))], "trade_date date, m double")
    made = metrics.block_bootstrap_ci(daily, ["m"], 2, 1, replications=300)
    rows = made.collect()
    assert len(rows) == 3 and all(r["lower"] < r["estimate"] < r["upper"] for r in rows)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows))
    assert metrics.block_bootstrap_ci(daily.limit(30), ["m"], 2, 1).count() == 0


def test_fingerprint_ignores_order(spark, golden):
    a = quality.table_fingerprint(golden, golden.columns).first()
    assert a == quality.table_fingerprint(golden.orderBy(F.desc("close")).repartition(7), golden.columns).first()
    assert a != quality.table_fingerprint(golden.withColumn("vol", F.col("vol") + 1), golden.columns).first()


def test_files_in_other_formats(spark, golden, tmp_path):
    full = golden.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "raw_close": F.col("close"), "amount": F.col("vol"), "adj_factor": F.lit(1.0), "junk": F.lit("x")})
    full.write.json(str(tmp_path / "j"))
    full.write.option("header", True).csv(str(tmp_path / "c"))
    for kind, path, options in (("json", "j", {}), ("csv", "c", {"header": True, "inferSchema": True})):
        got = quality.read_panel(spark, str(tmp_path / path), kind, optional=("ext_observation", "none"), **options)
        assert got.columns == [*quality.REQUIRED, "ext_observation"] and got.count() == 50
    with pytest.raises(ValueError):
        quality.keep_columns(golden)


def test_stream_gives_the_bars_of_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    late = spark.createDataFrame([(10**9, dt.datetime(2030, 1, 1), "end", 0.0)], "event_id long, ts timestamp, event_type string, value double")
    source = events.select("event_id", "ts", "event_type", "value").unionByName(late)
    source.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    made = bars.daily_bars(bars.read_events(spark, str(tmp_path / "in"), source.schema))
    query = bars.write_bars(made, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, bars.daily_bars(events).collect()))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracles())))
def test_queries_without_sql_are_finite(spark, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    for c, kind in df.dtypes:
        if kind == "double":
            assert all(r[c] is None or np.isfinite(r[c]) for r in rows)


@pytest.mark.parametrize(("left", "accuracy"), [(100_000, 10_000), (50, 20), (3, 5), (1, 2)])
def test_quantiles_equal_sorting(spark, left, accuracy):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), float(rng.choice([1, 1, 1, 2, 7])), None, rng.choice([None, -0.5, 3.25, float(rng.randrange(400))])) for _ in range(900)]
    df = spark.createDataFrame(rows, "x double, ties double, none double, holes double").repartition(7)
    shares = (0.0, 0.01, 0.25, 0.5, 0.333, 0.99, 1.0)
    found = quantiles.quantiles(df, {f"{c} {p}": (c, p) for c in df.columns for p in shares}, left, accuracy).first()
    for i, c in enumerate(df.columns):
        own = [r[i] for r in rows if r[i] is not None]
        for p in shares:
            assert found[f"{c} {p}"] == (pytest.approx(np.quantile(own, p), abs=1e-12) if own else None)


def test_quantiles_of_few_rows(spark):
    one = spark.createDataFrame([(None, 2.5)], "x double, y double")
    assert quantiles.quantiles(one, {"a": ("x", 0.5), "b": ("y", 0.01)}).first().asDict() == {"a": None, "b": 2.5}
    assert quantiles.quantiles(one.filter("false"), {"a": ("x", 0.5)}).first()["a"] is None


@pytest.mark.parametrize("winsor", [True, False])
@pytest.mark.parametrize("scale", ["robust", "standard"])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 201])
def test_fold_parameters_are_those_of_steps(spark, n, winsor, scale):
    from factorlake.operators import preprocess

    rng = random.Random(n)
    rows = [(DAYS[i % 25], rng.choice([None, rng.gauss(0, 9), rng.gauss(0, 1)]), float(rng.choice([1, 1, 2, 50])), None) for i in range(n)]
    df = spark.createDataFrame(rows, "trade_date date, x double, ties double, none double").repartition(3)
    got = preprocess.fit_fold_transform(df, ["x", "ties", "none"], winsor, scale).first().asDict()
    for k, c in enumerate(("x", "ties", "none"), 1):
        own = np.array([np.nan if r[k] is None else r[k] for r in rows])
        if np.isnan(own).all():
            assert all(v is None for name, v in got.items() if name.startswith(f"{c}_"))
            continue
        lo, hi = np.nanquantile(own, [0.01, 0.99])
        own = np.clip(own, lo, hi) if winsor else own
        own = np.where(np.isnan(own), np.nanmedian(own), own)
        want = {"med": np.median(own) if not np.isnan(own).any() else None} | ({"lo": lo, "hi": hi} if winsor else {})
        q1, mid, q3 = np.quantile(own, [0.25, 0.5, 0.75])
        want |= {"mid": mid, "iqr": q3 - q1} if scale == "robust" else {"mean": own.mean(), "std": own.std()}
        want["med"] = got[f"{c}_med"] if scale == "standard" else want["med"]
        for name, v in want.items():
            assert got[f"{c}_{name}"] == pytest.approx(v, abs=1e-9), (c, name)
