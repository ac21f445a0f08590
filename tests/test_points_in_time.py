"""Lineage, ranks, bootstrap and refusals by hand."""

import datetime as dt
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake import plans
from factorlake.operators import asof, audit, labels, metrics, statements, universe
from factorlake.sources import quality, shared

DAY0 = dt.date(2020, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


def facts_of(spark, numbers):
    return spark.createDataFrame([(i, day(i * 7 % 50), None if i % 3 == 0 else day(i * 11 % 50), None) for i in numbers], "fact_id long, recorded date, retrieved date, published date").repartition(3)


def test_lineage_is_a_plain_recursion(spark):
    rng = random.Random(5)
    edges = {(i, j) for i in range(1, 60) for j in rng.sample(range(i), min(i, rng.randrange(3)))}
    own = {i: max([day(i * 7 % 50)] + ([day(i * 11 % 50)] if i % 3 else [])) for i in range(60)}

    def of(i):
        return max([own[i], *[of(j) for k, j in edges if k == i]])

    df = spark.createDataFrame([*edges, *list(edges)[:5]], "fact_id long, input_id long")
    got = asof.knowledge_time(facts_of(spark, range(60)), df, 60).collect()
    assert {r["fact_id"]: (r["known_at"], r["problem"]) for r in got} == {i: (of(i), None) for i in range(60)} and len(got) == 60


def test_lineage_tells_what_is_wrong(spark):
    # 1 <- 2 <- 3; a cycle 10 -> 11 -> 12 -> 10 with 13 behind it; 20 needs a stranger, 21 needs 20; a fact of itself
    edges = [(2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (13, 10), (13, 1), (20, 99), (20, 1), (21, 20), (21, 3), (30, 30)]
    df = spark.createDataFrame(edges, "fact_id long, input_id long")
    got = {r["fact_id"]: (r["known_at"] is not None, r["problem"]) for r in asof.knowledge_time(facts_of(spark, [1, 2, 3, 10, 11, 12, 13, 20, 21, 30, 40]), df).collect()}
    assert got == {i: (True, None) for i in (1, 2, 3, 40)} | {i: (False, "cycle") for i in (10, 11, 12, 13, 30)} | {20: (False, "unknown_input"), 21: (False, "unresolved_input")}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 9)], "fact_id long, input_id long")
    deep = {r["fact_id"]: r["problem"] for r in asof.knowledge_time(facts_of(spark, range(9)), chain, 5).collect()}
    assert deep == {i: None if i <= 5 else "too_deep" for i in range(9)}
    assert asof.knowledge_time(facts_of(spark, []), chain).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_mean_ranks(spark, n):
    rng = random.Random(n)
    values = [rng.choice([None, float(rng.randrange(30)), rng.gauss(0, 5)]) for _ in range(n)]
    own = sorted(v for v in values if v is not None)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    got = {r["x"]: r["rank"] for r in shared.mean_ranks(df, "x").collect()}
    assert got == {v: own.index(v) + (own.count(v) + 1) / 2 for v in set(own)}


def test_return_metrics_by_hand(spark):
    rng = np.random.default_rng(2)
    a = np.round(rng.standard_normal(200), 1)
    p = np.round(a * 0.5 + rng.standard_normal(200), 1)
    r = metrics.return_metrics(spark.createDataFrame([*zip(p.tolist(), a.tolist(), strict=True), (None, 1.0), (1.0, None)], "predicted double, actual double")).first()
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    mse, zero = np.mean((p - a) ** 2), np.mean(a**2)
    assert r["observations"] == 200 and r["relative_improvement"] == pytest.approx(1 - mse / zero) and r["spearman"] == pytest.approx(np.corrcoef(rank(p), rank(a))[0, 1])
    none = metrics.return_metrics(spark.createDataFrame([(0.5, 0.0), (0.1, 0.0)], "predicted double, actual double")).first()
    assert none["relative_improvement"] is None and none["r2"] is None


def test_bootstrap_sums_are_those_of_the_dates(spark):
    """The same draws, date by date."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal(50)
    daily = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x)], "trade_date date, m double").repartition(4)
    for r in metrics.block_bootstrap_ci(daily, ["m"], 3, 1, 40, 11).collect():
        size = r["block"]
        blocks = math.ceil(50 / size)
        draws = spark.range(40).crossJoin(spark.range(blocks).withColumnRenamed("id", "b")).select("id", "b", F.pmod(F.xxhash64(F.lit(f"11/{size}"), "id", F.col("b").cast("int")), F.lit(50)).alias("a"))
        means = {}
        for d in draws.collect():
            means.setdefault(d["id"], []).extend(x[(d["a"] + k) % 50] for k in range(min(size, 50 - d["b"] * size)))
        values = [np.mean(v) for v in means.values()]
        assert all(len(v) == 50 for v in means.values())
        assert (r["lower"], r["upper"]) == (pytest.approx(np.quantile(values, 0.025)), pytest.approx(np.quantile(values, 0.975))) and r["estimate"] == pytest.approx(x.mean())


def test_states_claimed_twice_are_refused(spark):
    bars = spark.createDataFrame([("A", day(0)), ("A", day(1))], "ts_code string, trade_date date")
    rows = [("A", day(0), "g", 1.0), ("A", day(0), "h", 2.0), ("A", day(1), "g", 3.0), ("A", day(1), "other", 9.0)]
    kind = "ts_code string, trade_date date, state string, value double"
    got = quality.compose_states(bars, spark.createDataFrame(rows, kind), ["g", "h"]).orderBy("trade_date").collect()
    assert [(r["g"], r["h"]) for r in got] == [(1.0, 2.0), (3.0, None)]
    with pytest.raises(Exception, match="claimed twice: g A 2020-01-02"):
        quality.compose_states(bars, spark.createDataFrame([*rows, ("A", day(1), "g", 3.0)], kind), ["g", "h"]).collect()


def test_booleans_are_no_numbers(spark):
    df = spark.createDataFrame([(1, "2.5", True), (2, "true", None), (3, "x", False), (4, None, None)], "i int, core string, external boolean")
    assert {r["i"]: r["bad_fields"] for r in quality.check_numeric_type(df, ["core"], ["external"]).collect()} == {1: "external", 2: "core", 3: "core,external"}


def test_reasons_fit_the_family(spark):
    rows = [("A", day(t), t, None if t == 1 else 10.0 + t, 0.5 if t != 6 else None, 1.0 if t != 4 else None, 0.0 if t < 3 else 2.0, None) for t in range(8)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, session_index int, close double, scale double, x double, e double, fd double")
    told = lambda **kw: [r["reason"] for r in labels.invalid_reason(df, ["x"], 2, **kw).orderBy("trade_date").collect()]
    assert told() == [None, "missing_origin_price", None, None, "no_observed_factor_input", None, "response_normalizer_unavailable", None]
    assert told(mode="association")[:4] == ["response_window_warmup", "response_window_warmup", None, "missing_origin_price"]
    assert told(family="event", events=["e"])[:4] == ["no_observed_event", "missing_origin_price", "no_observed_event", None]
    assert set(told(family="fundamental", reports=["fd"])) == {"no_observed_fundamental_predictor", "missing_origin_price", "no_observed_factor_input", "response_normalizer_unavailable"}


def test_pools_are_rows(spark):
    df = spark.createDataFrame([(f"S{i}", "x" if i < 4 else "y", "u" if i % 2 else None) for i in range(6)], "ts_code string, a string, b string")
    got = {(r["kind"], r["value"]): 0 for r in universe.build_pools(df, ["a", "b"], 3).collect()}
    rows = universe.build_pools(df, ["a", "b"], 3).collect()
    assert got.keys() == {("a", "x"), ("b", "u")} and len(rows) == 7 and {(r["value"], r["n_symbols"]) for r in rows} == {("x", 4), ("u", 3)}


def test_other_companies_have_no_states(spark):
    rows = [("A", day(100), 8079, "consolidated", "point", day(120), day(121), [], "1", "total_assets", 10.0), ("A", day(100), 8079, "consolidated", "point", day(120), day(121), [], "1", "total_liab", 4.0)]
    rows += [("B", *r[1:8], "2", *r[9:]) for r in rows]
    facts = spark.createDataFrame(rows, "ts_code string, end_date date, period_index int, scope string, basis string, disclosed date, available date, reasons array<string>, company_type string, field string, value double")
    asked = spark.createDataFrame([("A", day(130)), ("B", day(130))], "ts_code string, as_of date")
    state = {"liability_asset_share": statements.STATES["liability_asset_share"]}
    got = {r["ts_code"]: (r["value"], r["reasons"]) for r in statements.state_ratios(facts, asked, state).collect()}
    assert got == {"A": (0.4, []), "B": (None, ["UNSUPPORTED_COMPANY_TYPE"])}
    both = statements.state_ratios(facts, asked, state, company_types=("1", "2")).collect()
    assert {r["value"] for r in both} == {0.4}


def test_synthetic_panels_are_what_their_keys_say(spark):
    """Every cell once, the same whatever the partitions, with the moves that were asked for and whole bars."""
    days = spark.range(260).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    codes = spark.range(60).select(F.format_string("S%03d", "id").alias("ts_code"))
    one = quality.synthetic_panel(days, codes).orderBy("ts_code", "trade_date").collect()
    assert one == quality.synthetic_panel(days.repartition(3), codes.repartition(5)).orderBy("ts_code", "trade_date").collect()
    assert one != quality.synthetic_panel(days, codes, seed=8).orderBy("ts_code", "trade_date").collect()
    assert len({(r["ts_code"], r["trade_date"]) for r in one}) == len(one) == 260 * 60
    close = np.array([r["close"] for r in one]).reshape(60, 260)
    moves = np.diff(np.log(close), axis=1)
    market = moves.mean(axis=0)
    assert abs(market.std() - np.hypot(0.006, 0.012 / 60**0.5)) < 0.001 and abs((moves - market).std() - 0.012) < 0.0005
    for r in one:
        assert r["low"] < min(r["open"], r["close"]) <= max(r["open"], r["close"]) < r["high"] and r["vol"] > 0
        assert r["raw_close"] == r["close"] and r["adj_factor"] == 1.0 and math.isclose(r["amount"], r["vol"] * r["close"] / 10)


def test_states_are_dealt_by_symbol_alone(spark):
    """Facts aren't copied to the dates and quarters that ask for them: nothing is shuffled by date or period."""
    rows = [("S1", "total_assets", q, "consolidated", "point", f"20{q // 4:02d}-01-15", f"20{q // 4:02d}-02-01", [], float(q)) for q in range(4, 40, 4)]
    facts = spark.createDataFrame(rows, "ts_code string, field string, period_index int, scope string, basis string, disclosed string, available string, reasons array<string>, value double")
    facts = facts.withColumns({c: F.to_date(c) for c in ("disclosed", "available")}).withColumn("value", F.col("value").cast("decimal(30,4)"))
    made = statements.state_ratios(facts, statements.transitions(facts), {"assets_yoy": statements.STATES["assets_yoy"]})
    got = {r["period_index"]: r["value"] for r in made.collect()}
    assert got[4] is None and all(abs(got[q] - (q / (q - 4) - 1)) < 1e-12 for q in range(8, 40, 4)) and len(got) == 9
    plan = made._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert keys and not any(k.startswith(("period_index", "at#")) or ", at#" in k or ", period_index" in k for k in keys)


def test_intervals_meet_sessions_of_their_months(spark):
    """Sessions, not years of sessions, are made for an interval."""
    days = spark.range(731).select(F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    rows = [("A", "s", 1.0, "2001-01-31", "2001-02-01"), ("A", "s", 2.0, "2001-12-30", "2002-01-02"), ("B", "s", 3.0, "2001-05-02", "2001-05-01")]
    spans = spark.createDataFrame(rows, "ts_code string, state string, value double, a string, z string").withColumns({"from_date": F.to_date("a"), "through_date": F.to_date("z")})
    made = statements.expand_intervals(spans, days)
    assert sorted(str(r["trade_date"]) for r in made.collect()) == ["2001-01-31", "2001-02-01", "2001-12-30", "2001-12-31", "2002-01-01", "2002-01-02"]
    assert "month(" in made._jdf.queryExecution().executedPlan().toString()


def test_lineage_sends_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(asof, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or shared.cut(df))
    links = spark.createDataFrame([(i, i // 2) for i in range(2, 17)], "fact_id long, input_id long")
    assert asof.knowledge_time(facts_of(spark, range(1, 17)), links).count() == 16
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_domains_are_dealt_before_they_are_counted(spark):
    """No task that reads keys counts them."""
    kind = "ts_code string, trade_date int"
    expected = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 1), (None, 1)], kind)
    rows = spark.createDataFrame([("A", 1), ("B", 1), ("B", 1), ("C", 1), (None, 1)], kind)
    made = audit.check_complete_domain(expected, rows, ["ts_code", "trade_date"])
    got = sorted((str(r[0]), r[1], r[2]) for r in made.collect())
    assert got == [("A", 2, "missing"), ("B", 1, "repeated"), ("C", 1, "extra"), ("None", 1, "extra"), ("None", 1, "missing")]
    first, _, reads = made._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].rpartition("Exchange")
    assert "HashAggregate" in first and "HashAggregate" not in reads


def test_lineage_of_any_depth(spark, tmp_path):
    """Customers whose numbers are powers of two: thirty steps lead to the last, and the query says what its SQL says."""
    spark.range(31).select(F.expr("shiftleft(1L, int(id))").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = sorted(plans.queries()["knowledge_time"](spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == sorted(duck.execute(plans.oracles()["knowledge_time"]).fetchall()) and len(got) == 31
    assert all(r["known_at"] is not None and r["problem"] is None for r in got)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 400 facts with a base for each, a step of two inputs in its middle, and a ring of 50 facts with one behind it."""
    rounds = []
    monkeypatch.setattr(asof, "cut", lambda df: rounds.append(1) or shared.cut(df))
    chain = [(i, i - 1) for i in range(1, 400)] + [(i, 1000 + i) for i in range(400)] + [(200, 150), (200, 20)]
    ring = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(2050, 2000)]
    numbers = [*range(400), *range(1000, 1400), *range(2000, 2051)]
    got = asof.knowledge_time(facts_of(spark, numbers), spark.createDataFrame(chain + ring, "fact_id long, input_id long")).collect()
    own = {i: max(day(i * 7 % 50), day(i * 11 % 50) if i % 3 else DAY0) for i in numbers}
    expected = {i: (own[i], None) for i in range(1000, 1400)} | {2000 + i: (None, "cycle") for i in range(51)}
    for i in range(400):
        expected[i] = (max(own[i], own[1000 + i], expected[i - 1][0] if i else DAY0), None)
    assert {r["fact_id"]: (r["known_at"], r["problem"]) for r in got} == expected and len(got) == len(expected)
    assert len(rounds) < 25


def test_lineage_of_two_inputs_each_is_deep(spark):
    """Every fact needs the two before it: a round for each step, whose plans must not grow by the round."""
    links = spark.createDataFrame([(i, i - k) for i in range(28) for k in (1, 2) if i >= k], "fact_id long, input_id long")
    got = sorted((r["fact_id"], r["known_at"], r["problem"]) for r in asof.knowledge_time(facts_of(spark, range(28)), links).collect())
    own = [max(day(i * 7 % 50), day(i * 11 % 50) if i % 3 else DAY0) for i in range(28)]
    assert got == [(i, max(own[: i + 1]), None) for i in range(28)]
