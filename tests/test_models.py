"""Linear models, bases, boosting and time-ordered validation against plain loops over rows."""

import datetime as dt
import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import boosting, linear, models
from factorlake.operators.models import ModelSpec

DAY0 = dt.date(2021, 1, 1)
COLUMNS = ["a", "b", "c"]
DATES = 60


@pytest.fixture(scope="module")
def world(spark):
    """Eight symbols over sixty dates; labels end three dates later; some columns, labels and ends are missing."""
    rng = np.random.default_rng(12)
    rows = []
    for t in range(DATES):
        for k in range(8):
            a, b = rng.standard_normal(2)
            c = a * 0.99 + rng.standard_normal() * 0.05
            y = 0.5 * a - 0.3 * b * b + 0.2 * math.tanh(c) + rng.standard_normal() * 0.3 + k / 10
            a, b, y = (None if rng.random() < 0.03 else float(v) for v in (a, b, y))
            end = DAY0 + dt.timedelta(days=t + 3) if t + 3 < DATES else None
            rows.append((DAY0 + dt.timedelta(days=t), f"S{k}", end, a, b, float(c), y))
    return rows, spark.createDataFrame(rows, "trade_date date, ts_code string, label_end date, a double, b double, c double, label double").repartition(5).cache()


def whole(rows):
    return [r for r in rows if None not in r[3:]]


def term_values(term, x):
    v = {c: x[:, i] for i, c in enumerate(COLUMNS)}
    a = v[term.a]
    return {"power": lambda: a**term.degree, "product": lambda: a * v[term.b], "slog": lambda: np.sign(a) * np.log1p(abs(a)), "sexp": lambda: np.sign(a) * np.expm1(np.minimum(abs(a), 3))}[term.kind]()


def plain_net(x, y, alpha, mix):
    """Cyclic descent over rows, residuals and all."""
    x, mean = x - x.mean(axis=0), y.mean()
    n, w, left = len(y), np.zeros(x.shape[1]), y - mean
    for _ in range(20_000):
        old = w.copy()
        for j in range(len(w)):
            left = left + x[:, j] * w[j]
            pull = x[:, j] @ left / n
            w[j] = np.sign(pull) * max(abs(pull) - alpha * mix, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - mix))
            left = left - x[:, j] * w[j]
        if np.abs(w - old).max() < 1e-13:
            break
    return w


def plain_fit(rows, spec):
    """A function of rows of columns; None if there are too few rows."""
    if not rows:
        return None
    x, y = np.array([r[3:6] for r in rows], float), np.array([r[6] for r in rows])
    p = spec.params
    if spec.kind == "no_change":
        return lambda z: np.zeros(len(z))
    if spec.kind == "historical_drift":
        return lambda z: np.full(len(z), y.mean())
    family = linear.BASES.get(spec.kind, "")
    terms = linear.dictionary(COLUMNS, family)
    values = np.column_stack([term_values(t, x) for t in terms])
    center, scale = values.mean(axis=0), values.std(axis=0) if family else np.ones(len(terms))
    z = (values - center) / scale
    chosen = list(range(len(terms)))
    if spec.kind == "factorwise_basis":
        chosen = []
        for c in COLUMNS:
            own = [i for i, t in enumerate(terms) if t.a == c]
            w = plain_net(z[:, own], y, p["alpha"], p["l1_ratio"])
            chosen += [i for i, v in zip(own, w, strict=True) if abs(v) > 1e-12]
        kept = []
        for i in sorted(chosen or range(3)):
            if not any(abs(np.corrcoef(z[:, i], z[:, k])[0, 1]) >= 0.995 for k in kept):
                kept.append(i)
        chosen = kept
    if len(rows) < len(chosen) + 2:
        return None
    z = z[:, chosen]
    if "alpha" in p and "l1_ratio" in p:
        w = plain_net(z, y, p["alpha"], p["l1_ratio"])
    else:
        zc = z - z.mean(axis=0)
        w = np.linalg.solve(zc.T @ zc + p["alpha"] * np.eye(len(chosen)), zc.T @ (y - y.mean()))
    return lambda rows: (np.column_stack([term_values(terms[i], rows) for i in chosen]) - center[chosen]) / scale[chosen] @ w + y.mean() - z.mean(axis=0) @ w


SPECS = [
    ModelSpec("no_change"), ModelSpec("historical_drift"), ModelSpec("ridge", {"alpha": 1.0}), ModelSpec("ridge", {"alpha": 10.0}), ModelSpec("elastic_net", {"alpha": 0.02, "l1_ratio": 0.5}),
    ModelSpec("polynomial_ridge", {"alpha": 10.0}), ModelSpec("polynomial_elastic_net", {"alpha": 0.01, "l1_ratio": 0.5}), ModelSpec("transformed_ridge", {"alpha": 10.0}), ModelSpec("factorwise_basis", {"alpha": 0.01, "l1_ratio": 0.5}),
]


def day(t):
    return DAY0 + dt.timedelta(days=t)


FOLDS = [linear.Fold(0, day(1), day(4)), linear.Fold(1, day(20), day(29)), linear.Fold(2, day(30), day(44)), linear.Fold(3, day(45), day(59)), linear.Fold(9, day(30), day(44), day(40))]


def plain_score(rows, spec, fold, key=None):
    train = [r for r in whole(rows) if r[2] is not None and r[2] < fold.start]
    test = [r for r in whole(rows) if fold.start <= r[0] <= fold.end and (fold.before is None or (r[2] is not None and r[2] < fold.before))]
    fits = {k: plain_fit([r for r in train if key is None or r[1] == k], spec) for k in ([None] if key is None else {r[1] for r in rows})}
    daily = {}
    for r in test:
        f = fits[None if key is None else r[1]]
        if f is not None:
            daily.setdefault(r[0], []).append((f(np.array([r[3:6]], float))[0] - r[6]) ** 2)
    return np.mean([np.mean(v) for v in daily.values()]) if daily else None


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_fits_are_those_of_the_rows(world, spec):
    rows, df = world
    want = plain_fit(whole(rows), spec)
    made = models.fit_predict(df, df, COLUMNS, "label", spec).collect()
    assert len(made) == len(rows)
    for r in made:
        if None in (r["a"], r["b"], r["c"]):
            assert r["prediction"] is None or spec.kind in ("no_change", "historical_drift")
        else:
            assert r["prediction"] == pytest.approx(want(np.array([[r["a"], r["b"], r["c"]]]))[0], abs=2e-6)


def test_folds_are_trained_and_scored_as_rows_say(world):
    rows, df = world
    got = {(r["fold"], r["id"]): (r["status"], r["score"]) for r in models.cross_validate(df, COLUMNS, "label", SPECS, FOLDS).collect()}
    assert len(got) == len(SPECS) * len(FOLDS)
    for f in FOLDS:
        for s in SPECS:
            status, score = got[f.number, s.name]
            if f.number == 0:  # nothing ended before its first date
                assert status == "ValueError" and score is None
            else:
                assert status == "valid" and score == pytest.approx(plain_score(rows, s, f), rel=2e-5), (f, s.name)


def test_folds_of_each_security(world):
    rows, df = world
    spec = ModelSpec("per_target_ridge", {"alpha": 2.0})
    got = {r["fold"]: (r["status"], r["score"]) for r in models.cross_validate(df, COLUMNS, "label", [spec], FOLDS).collect()}
    plain = ModelSpec("ridge", {"alpha": 2.0})
    for f in FOLDS:
        want = plain_score(rows, plain, f, "ts_code")
        assert got[f.number] == (("no_rows", None) if want is None else ("valid", pytest.approx(want, rel=1e-6)))


def test_failures_are_kept(world):
    df = world[1]
    few = df.filter((F.col("trade_date") < F.lit(day(2))) | (F.col("trade_date") >= F.lit(day(20))))
    got = {r["id"]: r["status"] for r in models.cross_validate(few, COLUMNS, "label", SPECS, [linear.Fold(1, day(5), day(30))]).collect()}
    assert got["historical_drift"] == "valid" and {v for v in got.values()} <= {"valid", "ValueError"}
    none = models.cross_validate(df.filter("false"), COLUMNS, "label", SPECS[:2], FOLDS).collect()
    assert {r["status"] for r in none} == {"no_rows"} and all(r["score"] is None for r in none)


def test_nested_selection_is_that_of_the_rows(world):
    rows, df = world
    folds, specs = FOLDS[2:4], [SPECS[1], SPECS[2], SPECS[7]]
    got = {r["fold"]: (r["id"], r["score"]) for r in models.nested_selection(df, COLUMNS, "label", specs, folds).collect()}
    for f in folds:
        past = sorted({r[0] for r in rows if r[2] is not None and r[2] < f.start})
        first = max(10, len(past) // 2)
        size = (len(past) - first) // 2
        inner = [linear.Fold(0, past[first], past[first + size - 1], f.start), linear.Fold(1, past[first + size], past[-1], f.start)]
        trials = []
        for i, s in enumerate(specs):
            scores = [plain_score(rows, s, x) for x in inner]
            trials.append((np.mean(scores), np.std(scores, ddof=1) / 2**0.5, i, s))
        best = min(trials, key=lambda t: (t[0], t[2], t[3].name))
        chosen = min((t for t in trials if t[0] <= best[0] + best[1]), key=lambda t: (t[2], t[3].name))[3]
        assert got[f.number] == (chosen.name, pytest.approx(plain_score(rows, chosen, f), rel=1e-5))


@pytest.mark.parametrize("window", [9, 15, 500])
def test_sliding_refits_equal_their_windows(spark, world, window):
    rows, df = world
    refits = [day(2), day(12), day(13), day(20), day(33), day(58)]
    got = {(r["ts_code"], r["refit_date"]): r for r in linear.sliding_ridge(df, ["a", "b"], "label", spark.createDataFrame([(r,) for r in refits], "refit_date date"), 0.5, window).collect()}
    count = 0
    for at in refits:
        dates = sorted({r[0] for r in rows if r[2] is not None and r[2] < at})[-window:]
        for k in range(8):
            own = [r for r in rows if r[1] == f"S{k}" and r[0] in dates and None not in (r[3], r[4], r[6])]
            if len(own) < 4:
                assert (f"S{k}", at) not in got
                continue
            x, y = np.array([r[3:5] for r in own], float), np.array([r[6] for r in own])
            xc = x - x.mean(axis=0)
            w = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ (y - y.mean()))
            r = got[f"S{k}", at]
            assert r["n"] == len(own) and np.allclose(r["coefficients"], w) and r["intercept"] == pytest.approx(y.mean() - x.mean(axis=0) @ w)
            count += 1
    assert count == len(got) > 20


def test_frozen_candidates_know_their_errors(world):
    rows, df = world
    own = whole(rows)
    x, y = np.array([r[3:6] for r in own], float), np.array([r[6] for r in own])
    for r in models.freeze_candidates(df, COLUMNS, "label", SPECS).collect():
        spec = next(s for s in SPECS if s.name == r["id"])
        mse = np.mean((plain_fit(own, spec)(x) - y) ** 2)
        assert r["n"] == len(own) and r["mse"] == pytest.approx(mse, rel=1e-5) and r["r2"] == pytest.approx(1 - mse / y.var(), abs=1e-5)


def test_an_elastic_net_may_keep_nothing():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((40, 3)), rng.standard_normal(40)
    xc = x - x.mean(axis=0)
    assert not linear.elastic_net(xc.T @ xc, xc.T @ (y - y.mean()), 40, 10.0, 1.0).any()
    assert np.allclose(linear.elastic_net(xc.T @ xc, xc.T @ (y - y.mean()), 40, 0.05, 0.7), plain_net(x, y, 0.05, 0.7))


# ---------------------------------------------------------------- boosting
def plain_boost(x, y, rounds, leaves, l2, rate, least, points):
    """One leaf after another, best gain first, each from its own rows."""
    mean = y.mean()
    p, trees = np.full(len(y), mean), []

    def split(rows, g):
        best = None
        lone = g[rows].sum() ** 2 / (len(rows) + l2)
        for j in range(x.shape[1]):
            v = x[rows, j]
            gone = np.isnan(v)
            for t in [*points[j], math.inf]:
                for to_left in (True, False) if gone.any() else (False,):
                    left = np.where(gone, to_left, v <= t)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < least:
                        continue
                    gain = g[a].sum() ** 2 / (len(a) + l2) + g[b].sum() ** 2 / (len(b) + l2) - lone
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, j, t, to_left, a, b)
        return best

    for _ in range(rounds):
        g = p - y
        done, heap, made = [], [], 0
        first = split(np.arange(len(y)), g)
        if first is None:
            break
        heapq.heappush(heap, (-first[0], 0, first))
        while heap and len(done) + len(heap) < leaves:
            _, _, s = heapq.heappop(heap)
            for rows in s[4:]:
                made += 1
                nxt = split(rows, g)
                if nxt:
                    heapq.heappush(heap, (-nxt[0], made, nxt))
                else:
                    done.append(rows)
        done += [np.concatenate(h[2][4:]) for h in heap]
        step = np.zeros(len(y))
        for rows in done:
            step[rows] = -rate * g[rows].sum() / (len(rows) + l2)
        p = p + step
        trees.append(len(done))
    return p, trees


@pytest.mark.parametrize(("leaves", "l2"), [(2, 1.0), (7, 1.0), (15, 5.0)])
def test_boosting_equals_a_plain_one(spark, leaves, l2):
    rng = np.random.default_rng(leaves)
    n = 400
    x = rng.standard_normal((n, 3))
    x[:, 2] = rng.integers(0, 4, n)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * (x[:, 2] + 1) + x[:, 1] ** 2 + rng.standard_normal(n) * 0.2
    gone = rng.random(n) < 0.15
    x[gone, 1] = np.nan
    y[gone] += 4  # a split of the missing values alone pays
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, (-1, 0.0, 0.0, 0.0, None)], "i long, a double, b double, c double, y double").repartition(3)
    labelled = df.filter("y IS NOT NULL")
    points = boosting.cut_points(labelled, COLUMNS, 16)
    assert points[2] == [0.0, 1.0, 2.0] and all(len(p) <= 15 for p in points)
    want, sizes = plain_boost(x, y, 3, leaves, l2, 0.3, 20, points)
    model = boosting.fit_trees(df, COLUMNS, "y", 3, leaves, l2, 0.3, 20, 16, every=2)
    assert [sum(node["leaf"] for node in t) for t in model.first()["trees"]] == sizes
    assert max(sizes) > leaves - 3
    got = {r["i"]: r["prediction"] for r in boosting.score_trees(df, model, COLUMNS).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-9) and got[-1] is not None
    assert np.mean((want - y) ** 2) < y.var()


def test_boosting_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 30, "a double, y double")
    model = boosting.fit_trees(df, ["a"], "y", 3)
    assert [r["prediction"] for r in boosting.score_trees(df, model, ["a"]).distinct().collect()] == [2.0]
    with pytest.raises(ValueError):
        boosting.fit_trees(df.filter("false"), ["a"], "y")


def test_stored_trees_send_missing_values_their_way(spark):
    rng = random.Random(3)
    tree = [(0, 0.5, 1, 2, True, False, 0.0), (1, -1.0, 3, 4, False, False, 0.0), (-1, 0.0, -1, -1, False, True, 7.0), (-1, 0.0, -1, -1, False, True, 1.0), (-1, 0.0, -1, -1, False, True, 2.0)]
    model = spark.createDataFrame([(10.0, boosting.depth_of(tree), [tree, tree])], boosting.MODEL)
    rows = [(rng.choice([None, 0.5, 0.6, float("nan")]), rng.choice([None, -1.0, 3.0])) for _ in range(60)]
    lacks = lambda v: v is None or math.isnan(v)
    for r in boosting.score_trees(spark.createDataFrame(rows, "a double, b double"), model, ["a", "b"]).collect():
        leaf = 7.0 if not lacks(r["a"]) and r["a"] > 0.5 else 1.0 if not lacks(r["b"]) and r["b"] <= -1 else 2.0
        assert r["prediction"] == 10 + 2 * leaf


@pytest.fixture(scope="module")
def noisy(spark):
    """(frame, x, y): a linear response of two columns, with every ninth row far off."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 2)) * [1.0, 4.0] + [0.5, -2.0]
    y = x @ [1.5, -0.25] + 0.7 + rng.standard_normal(300) * 0.2
    y[::9] += rng.uniform(5, 30, len(y[::9]))
    rows = [("S", DAY0 + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, a double, b double, y double"), x, y


def test_huber_is_the_minimum_of_its_loss(noisy):
    """Against weights and a scale found in turns: squares within 1.35 scales, lines beyond."""
    df, x, y = noisy
    made = models.fit_predict(df, df, ["a", "b"], "y", models.ModelSpec("huber", {}))
    got = np.array([r["prediction"] for r in made.orderBy("trade_date").collect()])
    design, most = np.column_stack((x, np.ones(len(y)))), 1.35
    w = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(300):
        off = np.abs(y - design @ w)
        low, high = 1e-9, 1e3
        for _ in range(60):  # the loss's slope in the scale ascends with it
            scale = (low + high) / 2
            slope = np.where(off <= most * scale, 1 - (off / scale) ** 2, 1 - most**2).sum()
            low, high = (low, scale) if slope > 0 else (scale, high)
        weight = np.minimum(1.0, most * scale / np.maximum(off, 1e-300))
        w = np.linalg.solve(design.T @ (design * weight[:, None]), design.T @ (weight * y))
    assert np.abs(got - design @ w).max() < 5e-3
    plain = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.abs(got - plain).max() > 0.5


def test_bayesian_ridge_stands_at_its_fixed_point(noisy):
    """Noise and weight precision from the posterior of the centred rows, with its whole covariance inverted."""
    df, x, y = noisy
    fit = models.bayesian_ridge_fit(df, ["a", "b"], "y", tolerance=1e-12).first()
    xc, yc, w = x - x.mean(axis=0), y - y.mean(), np.array(fit["coefficients"])
    spread = np.linalg.inv(fit["lambda"] * np.eye(2) + fit["alpha"] * xc.T @ xc)
    assert np.allclose(w, fit["alpha"] * spread @ xc.T @ yc, rtol=1e-6)
    free = 2 - fit["lambda"] * np.trace(spread)
    assert np.isclose(fit["lambda"], (free + 2e-6) / (w @ w + 2e-6), rtol=1e-6)
    assert np.isclose(fit["alpha"], (len(y) - free + 2e-6) / (((yc - xc @ w) ** 2).sum() + 2e-6), rtol=1e-6)
    assert np.isclose(fit["intercept"], y.mean() - x.mean(axis=0) @ w) and fit["n"] == len(y)


def test_fits_of_many_securities_are_batches(world):
    """Per-security fits come from batches of securities, a row each, and are those of each one's rows."""
    rows, df = world
    refits = df.sparkSession.createDataFrame([(day(20),), (day(45),)], "refit_date date")
    fits = linear.sliding_fits(df, COLUMNS, "label", refits, 2.0, 10**9)
    assert "FlatMapGroupsInPandas" not in fits._jdf.queryExecution().executedPlan().toString()
    got = {(r["ts_code"], x["refit_date"]): (x["n"], x["intercept"], x["coefficients"]) for r in fits.collect() for x in r["fits"]}
    for at in (day(20), day(45)):
        for k in {r[1] for r in rows}:
            own = [r for r in whole(rows) if r[1] == k and r[2] is not None and r[2] < at]
            if len(own) < len(COLUMNS) + 2:
                assert (k, at) not in got
                continue
            n, b, w = got[k, at]
            said = plain_fit(own, ModelSpec("ridge", {"alpha": 2.0}))
            x = np.array([own[0][3:6]], float)
            assert n == len(own) and b + x[0] @ np.array(w) == pytest.approx(said(x)[0], rel=1e-8)


def test_folds_score_rows_within_tasks(world):
    """A row isn't copied for each candidate: tasks add up errors by fold, candidate and date."""
    rows, df = world
    terms = linear.terms_of(COLUMNS, [])
    fits = [(2, "p", 0.5, [0.25, 0.0, -1.0]), (9, "p", 0.5, [0.25, 0.0, -1.0])]
    made = linear.fold_errors(df, COLUMNS, "label", terms, FOLDS, fits)
    assert "Generate explode" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["fold"]: r["score"] for r in made.collect()}
    for f in (FOLDS[2], FOLDS[4]):
        daily = {}
        for r in whole(rows):
            if f.start <= r[0] <= f.end and (f.before is None or (r[2] is not None and r[2] < f.before)):
                daily.setdefault(r[0], []).append((0.5 + 0.25 * r[3] - r[5] - r[6]) ** 2)
        assert got[f.number] == pytest.approx(np.mean([np.mean(v) for v in daily.values()]), rel=1e-9)
    assert set(got) == {2, 9}


def test_quantile_passes_leave_no_copies_of_rows(spark):
    """Counts at any number of points, nulls and NaN among the values, come from one pass within tasks."""
    from factorlake.operators.quantiles import Columns

    values = [None, float("nan"), 3.0, -0.0, 0.0, 1.0, 1.0, 2.0, float("inf")]
    held = Columns(spark.createDataFrame([(v, 1.0) for v in values], "a double, b double").repartition(3), ["a", "b"])
    got = held.counts({("a", p) for p in (-1.0, 0.0, 1.0, 1.5, float("inf"))} | {("b", 1.0)})
    assert got == {("a", -1.0): (0, 0), ("a", 0.0): (0, 2), ("a", 1.0): (2, 4), ("a", 1.5): (4, 4), ("a", float("inf")): (6, 7), ("b", 1.0): (0, 9)}
    found = held.values({("a", k) for k in range(7)}, left=1)
    assert [found["a", k] for k in range(7)] == [0.0, 0.0, 1.0, 1.0, 2.0, 3.0, float("inf")]
    held.release()
