"""Models as Spark jobs. Linear models are solved from sums of products (see linear.py), one row for each group, so all
securities fit at once; boosting grows from histograms (see boosting.py); the others are pyspark.ml estimators on one
fold's rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting, linear
from .quantiles import quantiles
from .specs import ModelSpec
from .validation import all_present, in_folds, one_se_rule


#: What a fit itself may fail with.
FIT_ERRORS = (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException)


def factor_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the day's percentile ranks (ties share theirs) of the factors that a row has. All ranks are windows within
    a day: rows are dealt by day once."""
    day = Window.partitionBy("trade_date")
    made = df.withColumns({f"__n_{c}": F.count(c).over(day) for c in columns})
    own = lambda c: Window.partitionBy("trade_date", F.col(c).isNotNull()).orderBy(c)
    made = made.withColumns({f"__r_{c}": F.rank().over(own(c)) for c in columns} | {f"__t_{c}": F.count(c).over(Window.partitionBy("trade_date", c)) for c in columns})
    share = {c: F.when(F.col(c).isNotNull(), (F.col(f"__r_{c}") + (F.col(f"__t_{c}") - 1) / 2) / F.col(f"__n_{c}")) for c in columns}
    total = sum((F.coalesce(x, F.lit(0.0)) for x in share.values()), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return made.withColumn("score", F.when(count > 0, total / count)).drop(*[f"__{k}_{c}" for c in columns for k in "nrt"])


def no_change(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.lit(0.0))


def historical_drift(train: DataFrame, test: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """The train mean of the label."""
    if key:
        return test.join(train.groupBy(key).agg(F.avg(label).alias("prediction")), key, "left")
    return test.crossJoin(F.broadcast(train.agg(F.avg(label).alias("prediction"))))


def gram(df: DataFrame, columns: list[str], label: str, keys: list[str]) -> DataFrame:
    """Sums that a linear fit needs, for each group: n, the sums of features and label, and of all their products."""
    rows = df.filter(all_present([*columns, label]))
    names = [*columns, label]
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in names]).alias("sums"), F.array(*products).alias("products"))


def _moments(n: float, sums: np.ndarray, products: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Centred X'X, X'y and y'y, and the means."""
    full = np.zeros((p + 1, p + 1))
    full[np.triu_indices(p + 1)] = products
    full = full + np.triu(full, 1).T
    mean = sums / n
    centred = full - n * np.outer(mean, mean)
    return centred[:p, :p], centred[:p, p], float(centred[p, p]), mean


def ridge_fits(df: DataFrame, columns: list[str], label: str, alpha: float, keys: list[str]) -> DataFrame:
    """(keys, n, intercept, coefficients) of each group; groups with fewer rows than features plus two have none."""
    p = len(columns)

    def solve(batches):
        for pdf in batches:
            b0, b = [], []
            for n, sums, products in zip(pdf.n, pdf.sums, pdf.products, strict=True):
                if n < p + 2:
                    b0.append(None)
                    b.append(None)
                    continue
                xx, xy, _, mean = _moments(n, np.array(sums, float), np.array(products, float), p)
                w = np.linalg.solve(xx + alpha * np.eye(p), xy)
                b0.append(float(mean[p] - mean[:p] @ w))
                b.append(w.tolist())
            yield pdf[[*keys, "n"]].assign(intercept=pd.array(b0, "Float64"), coefficients=b)

    sums = gram(df, columns, label, keys)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kinds + ', ' if keys else ''}n long, intercept double, coefficients array<double>")


def bayesian_ridge_fit(df: DataFrame, columns: list[str], label: str, rounds: int = 300, tolerance: float = 1e-3) -> DataFrame:
    """Evidence-maximised ridge from one distributed pass of sums: (n, intercept, coefficients, alpha, lambda)."""
    p = len(columns)

    def solve(batches):
        for pdf in batches:
            for n, sums, products in zip(pdf.n, pdf.sums, pdf.products, strict=True):
                if n < p + 2:
                    continue
                xx, xy, yy, mean = _moments(n, np.array(sums, float), np.array(products, float), p)
                values, vectors = np.linalg.eigh(xx)
                values = np.clip(values, 0, None)
                noise, weight = 1 / max(yy / n, 1e-12), 1.0
                w = np.zeros(p)
                for _ in range(rounds):
                    before = w
                    w = vectors @ ((vectors.T @ xy) / (values + weight / noise))
                    sse = max(yy - 2 * w @ xy + w @ xx @ w, 0.0)
                    gamma = float((noise * values / (weight + noise * values)).sum())
                    weight = (gamma + 2e-6) / (w @ w + 2e-6)
                    noise = (n - gamma + 2e-6) / (sse + 2e-6)
                    if np.abs(before - w).sum() < tolerance:
                        break
                yield pd.DataFrame({"n": [n], "intercept": [float(mean[p] - mean[:p] @ w)], "coefficients": [w.tolist()], "alpha": [float(noise)], "lambda": [float(weight)]})

    return gram(df, columns, label, []).mapInPandas(solve, "n long, intercept double, coefficients array<double>, alpha double, lambda double")


def score_linear(df: DataFrame, fits: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Stored coefficients applied to rows; null where a feature or the fit is missing."""
    slim = fits.select(*keys, "intercept", "coefficients")
    joined = df.join(slim, keys, "left") if keys else df.crossJoin(F.broadcast(slim.limit(1)))
    dot = sum((F.get("coefficients", F.lit(i)) * F.col(c) for i, c in enumerate(columns)), F.col("intercept"))
    return joined.withColumn("prediction", dot).drop("intercept", "coefficients")


def estimator(spec: ModelSpec, label: str):
    """The pyspark.ml estimator of a spec."""
    p = spec.params
    if spec.kind == "huber":
        return LinearRegression(featuresCol="features", labelCol=label, loss="huber", epsilon=p.get("epsilon", 1.35), regParam=1e-4)
    if spec.kind == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=p.get("trees", 64), maxDepth=p.get("depth", 5), minInstancesPerNode=p.get("leaf", 20), featureSubsetStrategy="0.7", seed=7)
    raise ValueError(f"no model of kind {spec.kind}")


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], label: str, spec: ModelSpec) -> DataFrame:
    """`test` with a prediction; rows that lack a feature have none."""
    if spec.kind in linear.KINDS:
        return linear.fit_predict(train, test, columns, label, spec)
    if spec.kind == "gradient_boosting":
        return boosting.fit_predict(train, test, columns, label, **spec.params)
    if spec.kind == "per_target_ridge":
        fits = ridge_fits(train, columns, label, spec.params.get("alpha", 1.0), ["ts_code"])
        return score_linear(test, fits, columns, ["ts_code"])
    if spec.kind == "bayesian_ridge":
        return score_linear(test, bayesian_ridge_fit(train, columns, label), columns, [])
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    rows = assemble.transform(train.filter(all_present([*columns, label])))
    scored = assemble.transform(test.filter(all_present(columns)))
    fitted = estimator(spec, label).fit(rows).transform(scored)
    keys = ["trade_date", "ts_code"]
    return test.join(fitted.select(*keys, "prediction"), keys, "left")


def transformed_basis(df: DataFrame, columns: list[str]) -> DataFrame:
    """Powers, signed logarithm and signed exponential of each column, as columns <c>_<term>. Only the exponential's input
    is cut off, at linear.MOST_EXPONENT."""
    made: dict[str, Column] = {}
    for c in columns:
        terms = {"p1": linear.Term("power", c), "p2": linear.Term("power", c, degree=2), "p3": linear.Term("power", c, degree=3), "slog": linear.Term("slog", c), "sexp": linear.Term("sexp", c)}
        made |= {f"{c}_{n}": t.column() for n, t in terms.items()}
    return df.withColumns(made)


def restore_levels(df: DataFrame) -> DataFrame:
    """Prices and returns from predicted moves over a scale."""
    return df.withColumns({"level": F.col("state") + F.col("scale") * F.col("prediction"), "expected_return": F.col("prediction") * F.col("scale") / F.col("state"), "expected_price": F.col("state") * (1 + F.col("prediction") * F.col("scale") / F.col("state"))})


def state_effect(train: DataFrame, fits: DataFrame, columns: list[str], state: str, keys: list[str], rows: int = 128) -> DataFrame:
    """Mean change of predictions when one column goes from its lower to its upper quartile of the train rows, over at most
    `rows` train rows, evenly placed by date and symbol."""
    ends = quantiles(train, {"__lo": (state, 0.25), "__hi": (state, 0.75)})
    some = evenly_placed(train, rows, ["trade_date", "ts_code"]).crossJoin(F.broadcast(ends))
    low = score_linear(some.withColumn(state, F.col("__lo")), fits, columns, keys).select("trade_date", "ts_code", F.col("prediction").alias("a"))
    high = score_linear(some.withColumn(state, F.col("__hi")), fits, columns, keys).select("trade_date", "ts_code", F.col("prediction").alias("b"))
    return low.join(high, ["trade_date", "ts_code"]).agg(F.avg(F.col("b") - F.col("a")).alias("effect"), F.count(F.col("b") - F.col("a")).alias("n"))


def evenly_placed(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """The rows at places floor(i * (n - 1) / (m - 1)) in the order of (date, ...) , both ends included, m = min(rows, n). Places
    are counted by date first, so no task sees more than a date's rows."""
    days = df.groupBy(order[0]).agg(F.count("*").alias("__rows"))
    before = days.withColumn("__before", F.sum("__rows").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)))
    total = days.agg(F.sum("__rows").alias("__total"))
    place = F.coalesce("__before", F.lit(0)) + F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])) - 1
    placed = df.join(F.broadcast(before), order[0]).crossJoin(F.broadcast(total)).withColumn("__place", place)
    steps = F.greatest(F.least(F.col("__total"), F.lit(rows)) - 1, F.lit(1))
    nearest = F.ceil(F.col("__place") * steps / F.greatest(F.col("__total") - 1, F.lit(1)))
    kept = placed.filter((nearest <= steps) & (F.floor(nearest * (F.col("__total") - 1) / steps) == F.col("__place")))
    return kept.drop("__rows", "__before", "__total", "__place")


def folds_of(folds: DataFrame) -> list[linear.Fold]:
    """The folds' table, a handful of rows, as values."""
    return [linear.Fold(r["fold"], r["test_start"], r["test_end"]) for r in sorted(folds.select("fold", "test_start", "test_end").collect())]


SCORES = "id string, fold int, score double, status string"


def cross_validate(samples: DataFrame, columns: list[str], label: str, specs: list[ModelSpec], folds: list[linear.Fold]) -> DataFrame:
    """(id, fold, score, status): each candidate's mean over dates of the day's squared error in each fold. A candidate
    that can't be fit is kept with its failure.

    All linear candidates of all folds are one job, and those for each security another; each other candidate and fold
    is one of its own.
    """
    parts = []
    if own := [s for s in specs if s.kind in linear.KINDS]:
        parts.append(linear.cross_validate(samples, columns, label, own, folds))
    parts += [_each_target(samples, columns, label, s, folds) for s in specs if s.kind == "per_target_ridge"]
    if rest := [s for s in specs if s.kind not in linear.KINDS and s.kind != "per_target_ridge"]:
        parts.append(_one_by_one(samples, columns, label, rest, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _daily_scores(rows: DataFrame, label: str, keys: list[str]) -> DataFrame:
    daily = rows.groupBy(*keys, "trade_date").agg(F.avg((F.col("prediction") - F.col(label)) ** 2).alias("e"))
    return daily.groupBy(*keys).agg(F.avg("e").alias("score"))


def _folds_table(samples: DataFrame, folds: list[linear.Fold]) -> DataFrame:
    return samples.sparkSession.createDataFrame([(f.number, f.start, f.end, f.before) for f in folds], "fold int, test_start date, test_end date, before date")


def _each_target(samples: DataFrame, columns: list[str], label: str, spec: ModelSpec, folds: list[linear.Fold]) -> DataFrame:
    table = _folds_table(samples, folds)
    fits = linear.sliding_fits(samples, columns, label, table.select(F.col("test_start").alias("refit_date")), spec.params.get("alpha", 1.0), 10**9)
    held = [F.when(linear.inside(f), F.struct(F.lit(f.number).alias("fold"), F.lit(f.start).alias("refit_date"))) for f in folds]
    tested = samples.filter(all_present([*columns, label])).select("ts_code", "trade_date", *columns, label, F.array_compact(F.array(*held)).alias("__folds")).filter(F.size("__folds") > 0)
    joined = tested.join(fits, "ts_code").withColumn("__fold", F.explode("__folds"))  # a row is dealt once, whatever folds test it
    own = F.get(F.filter("fits", lambda x: x["refit_date"] == F.col("__fold.refit_date")), F.lit(0))
    rows = joined.select("trade_date", *columns, label, F.col("__fold.fold").alias("fold"), own.alias("__fit")).filter("__fit IS NOT NULL")
    said = sum((F.get("__fit.coefficients", F.lit(i)) * F.col(c) for i, c in enumerate(columns)), F.col("__fit.intercept"))
    scores = _daily_scores(rows.withColumn("prediction", said), label, ["fold"])
    return table.select("fold").join(scores, "fold", "left").select(F.lit(spec.name).alias("id"), "fold", "score", F.when(F.col("score").isNull(), "no_rows").otherwise("valid").alias("status"))


def _one_by_one(samples: DataFrame, columns: list[str], label: str, specs: list[ModelSpec], folds: list[linear.Fold]) -> DataFrame:
    spark = samples.sparkSession
    roles = in_folds(samples, _folds_table(samples, folds)).select("trade_date", "ts_code", "label_end", *columns, label, "fold", "role").persist()
    rows = []
    for f in folds:
        own = roles.filter(F.col("fold") == f.number)
        test = own.filter("role = 'test'") if f.before is None else own.filter((F.col("role") == "test") & (F.col("label_end") < F.lit(f.before)))
        for spec in specs:
            try:
                made = fit_predict(own.filter("role = 'train'"), test, columns, label, spec)
                found = _daily_scores(made.filter(all_present(["prediction", *columns, label])).withColumn("__one", F.lit(1)), label, ["__one"]).first()
                rows.append((spec.name, f.number, found["score"] if found else None, "valid" if found else "no_rows"))
            except FIT_ERRORS as e:  # a candidate's own failure is a result; a lost executor or a full disk is not
                rows.append((spec.name, f.number, None, type(e).__name__))
    roles.unpersist()
    return spark.createDataFrame(rows, SCORES)


def summarize_trials(scores: DataFrame, complexity: dict[str, int]) -> DataFrame:
    """One row for each candidate for validation.one_se_rule()."""
    known = F.create_map(*[F.lit(x) for pair in complexity.items() for x in pair])
    n_folds = F.count("*")
    made = scores.groupBy("id").agg(F.avg("score").alias("score"), (F.stddev_samp("score") / F.sqrt(F.count("score"))).alias("se"), F.when(F.count("score") == n_folds, "valid").otherwise("failed").alias("status"))
    return made.withColumn("complexity", F.coalesce(F.try_element_at(known, F.col("id")), F.lit(99)))


def inner_folds(samples: DataFrame, folds: list[linear.Fold], inner: int) -> dict[int, list[linear.Fold]]:
    """For each outer fold the inner ones, over the dates whose labels ended before it: after half of them (ten at least),
    blocks of one size, the last of which takes the rest. What comes to the driver is the calendar."""
    ends = samples.filter("label_end IS NOT NULL").groupBy("trade_date").agg(F.min("label_end").alias("e"))
    dates = sorted((r["trade_date"], r["e"]) for r in ends.collect())
    out, number = {}, 0
    for f in folds:
        past = [d for d, e in dates if e < f.start]
        first = max(10, len(past) // 2)
        size = (len(past) - first) // inner
        out[f.number] = []
        for k in range(inner if size > 0 else 0):
            own = past[first + k * size : first + (k + 1) * size if k < inner - 1 else None]
            number += 1
            out[f.number].append(linear.Fold(1_000_000 + number, own[0], own[-1], f.start))
    return out


def nested_selection(samples: DataFrame, columns: list[str], label: str, specs: list[ModelSpec], folds: list[linear.Fold], inner: int = 2) -> DataFrame:
    """(fold, id, score): within each outer fold's train rows a model is chosen by inner folds; the outer score is only
    reported. Inner and outer folds are validated together; what is chosen from are the scores, a row for each candidate
    and fold."""
    within = inner_folds(samples, folds, inner)
    every = [*folds, *[f for own in within.values() for f in own]]
    scores = cross_validate(samples, columns, label, specs, every).persist()
    order = {s.name: i for i, s in enumerate(specs)}
    out = None
    for f in folds:
        trials = summarize_trials(scores.filter(F.col("fold").isin([x.number for x in within[f.number]])), order)
        chosen = one_se_rule(trials).select("id")
        one = scores.filter(F.col("fold") == f.number).join(chosen, "id").select("fold", "id", "score")
        out = one if out is None else out.unionByName(one)
    made = samples.sparkSession.createDataFrame(out.collect(), "fold int, id string, score double")  # a row for each outer fold
    scores.unpersist()
    return made


def sequential_refit_forecast(samples: DataFrame, columns: list[str], label: str, schedule: DataFrame, alpha: float = 1.0, window: int = 60) -> DataFrame:
    """Each origin of the schedule (trade_date, refit_date) with a per-security ridge fit on the last `window` sessions
    whose labels ended before its refit; every origin is kept, without prediction where there is no model.

    All refits are one job, and no sample is copied into windows: see linear.sliding_ridge().
    """
    fits = linear.sliding_ridge(samples, columns, label, schedule.select("refit_date"), alpha, window)
    origins = samples.join(F.broadcast(schedule), "trade_date")  # as long as the calendar
    made = score_linear(origins, fits, columns, ["ts_code", "refit_date"])
    return made.withColumn("status", F.when(F.col("prediction").isNull(), "no_model").otherwise("valid"))


def freeze_candidates(samples: DataFrame, columns: list[str], label: str, specs: list[ModelSpec]) -> DataFrame:
    """(id, n, mse, r2) in sample of each candidate fit once on all development rows that have all columns. The errors of
    linear candidates follow from their sums: no row is scored."""
    r2 = F.when(F.col("variance") > 1e-20, 1 - F.col("mse") / F.col("variance")).alias("r2")
    own = [s for s in specs if s.kind in linear.KINDS]
    out = linear.linear_fits(samples, columns, label, own).select("id", "n", "mse", r2) if own else None
    for spec in (s for s in specs if s.kind not in linear.KINDS):
        made = fit_predict(samples, samples, columns, label, spec).filter(all_present(["prediction", *columns, label]))
        one = made.agg(F.count("*").alias("n"), F.avg((F.col("prediction") - F.col(label)) ** 2).alias("mse"), F.var_pop(label).alias("variance")).select(F.lit(spec.name).alias("id"), "n", "mse", r2)
        out = one if out is None else out.unionByName(one)
    return out
