"""Linear models and bases solved from sums of products.

All that a linear fit needs of its rows is one matrix of sums. Rows are summed once by time block; what a fold or a refit
trains on is a running sum of blocks, or the difference of two, so no row is copied into folds or windows, and all folds
and candidates are one job. Terms of a basis are standardised by the means and variances in the same sums; penalties of
one design share one decomposition; elastic nets are coordinate descents on the matrix.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .specs import ModelSpec

#: Inputs of the signed exponential are cut off here, in size.
MOST_EXPONENT = 3.0
#: Terms that correlate so much with one kept before repeat it.
ALIKE = 0.995
BASES = {"polynomial_ridge": "polynomial", "polynomial_elastic_net": "polynomial", "transformed_ridge": "transformed", "factorwise_basis": "transformed"}
KINDS = {"no_change", "historical_drift", "ridge", "elastic_net", *BASES}


@dataclass(frozen=True)
class Term:
    """A power (a, degree), a product (a, b), a signed logarithm or a signed exponential of a column."""

    kind: str
    a: str
    b: str | None = None
    degree: int = 1

    @property
    def name(self) -> str:
        return {"power": f"{self.a}^{self.degree}", "product": f"{self.a}*{self.b}"}.get(self.kind, f"{self.kind}({self.a})")

    def column(self) -> Column:
        x = F.col(self.a).cast("double")
        if self.kind == "power":
            return reduce(Column.__mul__, [x] * self.degree)
        if self.kind == "product":
            return x * F.col(self.b).cast("double")
        if self.kind == "slog":
            return F.signum(x) * F.log1p(F.abs(x))
        return F.signum(x) * F.expm1(F.least(F.abs(x), F.lit(MOST_EXPONENT)))

    def values(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The same of arrays."""
        a = x[self.a]
        if self.kind == "power":
            return reduce(np.multiply, [a] * self.degree)
        if self.kind == "product":
            return a * x[self.b]
        if self.kind == "slog":
            return np.sign(a) * np.log1p(np.abs(a))
        return np.sign(a) * np.expm1(np.fmin(np.abs(a), MOST_EXPONENT))


def dictionary(columns: list[str], family: str) -> list[Term]:
    """The columns themselves, then the family's terms: squares and products, or each column's square, cube, signed
    logarithm and signed exponential."""
    first = [Term("power", c) for c in columns]
    if family == "polynomial":
        return [*first, *[Term("power", c, degree=2) for c in columns], *[Term("product", a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]]
    if family == "transformed":
        return [*first, *[t for c in columns for t in (Term("power", c, degree=2), Term("power", c, degree=3), Term("slog", c), Term("sexp", c))]]
    return first


def terms_of(columns: list[str], specs: Iterable[ModelSpec]) -> list[Term]:
    """All terms that the specs need, each once."""
    return list(dict.fromkeys(t for family in ["", *sorted({BASES.get(s.kind, "") for s in specs})] for t in dictionary(columns, family)))


def block_sums(df: DataFrame, terms: list[Term], label: str, block: str) -> DataFrame:
    """(block, sums): for each value of the column `block` the sums of all products of (1, terms, label), row by row of the
    matrix. Rows that lack a column or the label don't count.

    A task adds up its own rows first, so what is shuffled is a matrix for each task and block."""
    used = sorted({c for t in terms for c in (t.a, t.b) if c})
    rows = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*used, label, block]]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            raw = {c: batch.column(k + 2).to_numpy() for k, c in enumerate(used)}
            x = np.column_stack([np.ones(len(own)), *[t.values(raw) for t in terms], batch.column(1).to_numpy()])
            for b in np.unique(own).tolist():
                part = x[own == b]
                sums[b] = sums.get(b, 0.0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], names=["block", "sums"])

    columns = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(used)]
    parts = rows.select(F.col(block).cast("int").alias("block"), F.col(label).cast("double").alias("y"), *columns).mapInArrow(add, "block int, sums array<double>")
    cells = parts.select("block", F.posexplode("sums").alias("k", "v")).groupBy("block", "k").agg(F.sum("v").alias("v"))
    return cells.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("sums"))


class Sums:
    """Moments of (terms, label) from a matrix of sums."""

    def __init__(self, matrix: np.ndarray):
        self.n = float(matrix[0, 0])
        self.mean = matrix[0, 1:] / self.n if self.n else matrix[0, 1:]
        centred = matrix[1:, 1:] - self.n * np.outer(self.mean, self.mean)
        self.xx, self.xy, self.yy = centred[:-1, :-1], centred[:-1, -1], float(centred[-1, -1])
        self._decomposed: dict[tuple, tuple] = {}

    def design(self, chosen: list[int], standard: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """X'X and X'y of the chosen terms, and what they were divided by."""
        scale = np.sqrt(np.maximum(np.diag(self.xx)[chosen], 0) / self.n) if standard else np.ones(len(chosen))
        scale = np.where(scale < 1e-12, 1.0, scale)
        return self.xx[np.ix_(chosen, chosen)] / np.outer(scale, scale), self.xy[chosen] / scale, scale

    def ridge(self, chosen: list[int], alpha: float, standard: bool) -> np.ndarray:
        key = (tuple(chosen), standard)
        if key not in self._decomposed:
            xx, xy, scale = self.design(chosen, standard)
            self._decomposed[key] = (*np.linalg.eigh(xx), xy, scale)
        values, vectors, xy, scale = self._decomposed[key]
        return vectors @ ((vectors.T @ xy) / (np.maximum(values, 0) + alpha)) / scale


def elastic_net(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float, l1_ratio: float, rounds: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """Coefficients that make half the mean square plus alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2) least, by
    coordinate descent on X'X and X'y."""
    w, left = np.zeros(len(xy)), xy.astype(float).copy()  # left: X'(y - Xw)
    cut, weight = n * alpha * l1_ratio, np.diag(xx) + n * alpha * (1 - l1_ratio)
    size = np.abs(xy).max(initial=0.0) / n
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if weight[j] <= 0:
                continue
            pull = left[j] + xx[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - cut, 0.0) / weight[j]
            if new != w[j]:
                left -= xx[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]) * np.sqrt(max(xx[j, j] / n, 0.0)))
                w[j] = new
        if most <= tolerance * max(size, 1e-300):
            return w
    raise ArithmeticError("the coordinate descent did not end")


def factorwise(sums: Sums, terms: list[Term], places: list[int], alpha: float, l1_ratio: float) -> list[int]:
    """The terms that an elastic net of each column's own terms keeps, less those that repeat one kept before; all columns
    as they are if nothing is kept of any."""
    chosen: list[int] = []
    for column in dict.fromkeys(terms[i].a for i in places):
        own = [i for i in places if terms[i].a == column]
        xx, xy, _ = sums.design(own, True)
        w = elastic_net(xx, xy, sums.n, alpha, l1_ratio)
        chosen += [i for i, v in zip(own, w, strict=True) if abs(v) > 1e-12]
    if not chosen:
        chosen = [i for i in places if terms[i].kind == "power" and terms[i].degree == 1]
    kept: list[int] = []
    spread = np.sqrt(np.maximum(np.diag(sums.xx), 0))
    for i in sorted(chosen, key=places.index):
        alike = (k for k in kept if spread[i] > 1e-12 and spread[k] > 1e-12 and abs(sums.xx[i, k]) >= ALIKE * spread[i] * spread[k])
        if next(alike, None) is None:
            kept.append(i)
    return kept


def solve(sums: Sums, spec: ModelSpec, terms: list[Term], columns: list[str]) -> tuple[float, np.ndarray]:
    """Intercept and coefficients over `terms` (zero where the spec has none of them)."""
    p, w = spec.params, np.zeros(len(terms))
    if spec.kind == "no_change":
        return 0.0, w
    if spec.kind != "historical_drift":
        family = BASES.get(spec.kind, "")
        places = [terms.index(t) for t in dictionary(columns, family)]
        if spec.kind == "factorwise_basis":
            places = factorwise(sums, terms, places, p.get("alpha", 1e-3), p.get("l1_ratio", 0.5))
        if sums.n < len(places) + 2:
            raise ValueError("fewer rows than terms")
        if spec.kind in ("ridge", "polynomial_ridge", "transformed_ridge"):
            w[places] = sums.ridge(places, p.get("alpha", 1.0), bool(family))
        else:
            xx, xy, scale = sums.design(places, bool(family))
            w[places] = elastic_net(xx, xy, sums.n, p.get("alpha", 1e-3), p.get("l1_ratio", 0.5)) / scale
    return float(sums.mean[-1] - sums.mean[:-1] @ w), w


FITS = "fold int, id string, n long, intercept double, coefficients array<double>, mse double, variance double, status string"


def fit_blocks(blocks: DataFrame, uses: dict[int, int], terms: list[Term], columns: list[str], specs: list[ModelSpec]) -> DataFrame:
    """FITS of every candidate for each fold: `uses` says for a fold up to which block it trains. A candidate that can't
    be fitted is kept with its failure. The blocks' matrices, one for each block, are one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width, out = len(terms) + 2, []
        matrices = {int(b): np.array(s, float).reshape(width, width) for b, s in zip(pdf.block, pdf.sums, strict=True)}
        for fold, upto in uses.items():
            sums = Sums(sum((m for b, m in sorted(matrices.items()) if b <= upto), np.zeros((width, width))))
            for spec in specs:
                try:
                    if not sums.n:
                        raise ValueError("no rows")
                    intercept, w = solve(sums, spec, terms, columns)
                    gap = float(sums.mean[-1] - sums.mean[:-1] @ w) - intercept
                    mse = (sums.yy - 2 * w @ sums.xy + w @ sums.xx @ w) / sums.n + gap**2
                    out.append((fold, spec.name, int(sums.n), intercept, w.tolist(), float(mse), sums.yy / sums.n, "valid"))
                except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                    out.append((fold, spec.name, int(sums.n), None, None, None, None, type(e).__name__))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")])
        return made.assign(**{c: made[c].astype("Float64") for c in ("intercept", "mse", "variance")})

    return blocks.groupBy().applyInPandas(run, FITS)


def linear_fits(train: DataFrame, columns: list[str], label: str, specs: list[ModelSpec]) -> DataFrame:
    """FITS of each candidate on all rows, as fold 0, from one pass over them."""
    terms = terms_of(columns, specs)
    return fit_blocks(block_sums(train.withColumn("__block", F.lit(0)), terms, label, "__block"), {0: 0}, terms, columns, specs)


def score_terms(df: DataFrame, fits: DataFrame, terms: list[Term], keys: list[str]) -> DataFrame:
    """Stored fits applied to rows: the intercept plus coefficients times terms, null where a needed column is missing.
    `fits` has keys, intercept and coefficients; a term of coefficient zero needs no column."""
    joined = df.join(fits.select(*keys, "intercept", "coefficients"), keys, "left") if keys else df.join(F.broadcast(fits.limit(1).select("intercept", "coefficients")))
    part = lambda i, t: F.when(F.get("coefficients", F.lit(i)) != 0, F.get("coefficients", F.lit(i)) * t.column()).when(F.get("coefficients", F.lit(i)) == 0, F.lit(0.0))
    return joined.withColumn("prediction", sum((part(i, t) for i, t in enumerate(terms)), F.col("intercept"))).drop("intercept", "coefficients")


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], label: str, spec: ModelSpec) -> DataFrame:
    """`test` with a prediction; rows that lack a column have none, but for constants."""
    terms = terms_of(columns, [spec])
    made = score_terms(test, linear_fits(train, columns, label, [spec]), terms, [])
    if spec.kind in ("no_change", "historical_drift"):
        return made
    return made.withColumn("prediction", F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), F.col("prediction")))


@dataclass(frozen=True)
class Fold:
    """Rows of dates from start to end are tested; rows whose labels ended before start are trained on. `before`: only
    rows whose labels ended before that date are tested."""

    number: int
    start: dt.date
    end: dt.date
    before: dt.date | None = None


def cross_validate(samples: DataFrame, columns: list[str], label: str, specs: list[ModelSpec], folds: list[Fold]) -> DataFrame:
    """(id, fold, score, status): each candidate's mean over dates of the day's squared error in each fold. All candidates,
    constants too, are fitted and scored on the rows that have all columns and the label.

    Rows are read twice for all folds and candidates: once they are summed by the first fold that may train on them, a
    fold's sums being running sums, and once scored by all candidates of the folds that test them. Terms are made and
    rows scored within tasks, which add up their own errors by fold, candidate and date. Folds are a handful, as are
    candidates; their fits, a row for each of them both, come to the driver.
    """
    terms = terms_of(columns, specs)
    starts = sorted({f.start for f in folds})
    entry = reduce(lambda c, k: c.when(F.col("label_end") < F.lit(starts[k]), k), range(len(starts)), F)
    blocks = block_sums(samples.withColumn("__block", entry), terms, label, "__block")
    fits = fit_blocks(blocks, {f.number: starts.index(f.start) for f in folds}, terms, columns, specs).select("fold", "id", "intercept", "coefficients", "status").collect()
    scores = fold_errors(samples, columns, label, terms, folds, [(r["fold"], r["id"], r["intercept"], r["coefficients"]) for r in fits if r["status"] == "valid"])
    told = F.when(F.col("status") != "valid", F.col("status")).when(F.col("score").isNull(), F.lit("no_rows")).otherwise(F.lit("valid"))
    found = {(r["fold"], r["id"]): r["status"] for r in fits}
    every = samples.sparkSession.createDataFrame([(f.number, s.name, found.get((f.number, s.name))) for f in folds for s in specs], "fold int, id string, status string")
    return every.join(F.broadcast(scores), ["fold", "id"], "left").select("id", "fold", "score", told.alias("status"))


def inside(f: Fold) -> Column:
    """Whether a fold tests a row."""
    dated = (F.col("trade_date") >= F.lit(f.start)) & (F.col("trade_date") <= F.lit(f.end))
    return dated if f.before is None else dated & F.coalesce(F.col("label_end") < F.lit(f.before), F.lit(False))


def fold_errors(samples: DataFrame, columns: list[str], label: str, terms: list[Term], folds: list[Fold], fits: list[tuple]) -> DataFrame:
    """(fold, id, score): the mean over dates of the day's mean squared error of each fit (fold, id, intercept,
    coefficients) on the rows that its fold tests and that have all columns and the label."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*columns, label]])
    tested = samples.filter(whole & reduce(Column.__or__, [inside(f) for f in folds]))
    number = {f.number: i for i, f in enumerate(folds)}
    by: dict[int, list[tuple[int, float, np.ndarray, np.ndarray]]] = {}
    for k, (fold, _, intercept, coefficients) in enumerate(fits):
        w = np.array(coefficients, float)
        by.setdefault(number[fold], []).append((k, intercept, np.flatnonzero(w), w[w != 0]))  # a term of coefficient zero isn't looked at

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            dates, which = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            y = batch.column(1).to_numpy()
            raw = {c: batch.column(k + 2).to_numpy() for k, c in enumerate(columns)}
            x = np.column_stack([t.values(raw) for t in terms])
            for i, own in by.items():
                held = np.flatnonzero(batch.column(2 + len(columns) + i).to_numpy(zero_copy_only=False))
                if not len(held):
                    continue
                rows = np.bincount(which[held], minlength=len(dates))
                seen = np.flatnonzero(rows)
                part, of = x[held], y[held]
                for k, intercept, places, w in own:
                    sums = np.bincount(which[held], (part[:, places] @ w + intercept - of) ** 2, len(dates))
                    for d in seen.tolist():
                        cell = errors.setdefault((k, int(dates[d])), [0.0, 0])
                        cell[0] += sums[d]
                        cell[1] += int(rows[d])
        keys, cells = list(errors), list(errors.values())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([d for _, d in keys], pa.int32()), pa.array([c[0] for c in cells], pa.float64()), pa.array([c[1] for c in cells], pa.int64())], names=["fit", "day", "e", "n"])

    rows = tested.select(F.unix_date("trade_date").alias("day"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *[inside(f).alias(f"f{i}") for i, f in enumerate(folds)])
    daily = rows.mapInArrow(add, "fit int, day int, e double, n long").groupBy("fit", "day").agg((F.sum("e") / F.sum("n")).alias("e"))
    names = samples.sparkSession.createDataFrame([(k, fold, id_) for k, (fold, id_, *_) in enumerate(fits)], "fit int, fold int, id string")
    return daily.groupBy("fit").agg(F.avg("e").alias("score")).join(F.broadcast(names), "fit").select("fold", "id", "score")


def sliding_ridge(samples: DataFrame, columns: list[str], label: str, refits: DataFrame, alpha: float, window: int, key: str = "ts_code") -> DataFrame:
    """(key, refit_date, n, intercept, coefficients): a ridge fit for each key and refit on the last `window` dates whose
    labels ended before it; none where there are fewer rows than columns plus two."""
    return sliding_fits(samples, columns, label, refits, alpha, window, key).select(key, F.inline("fits"))


def sliding_fits(samples: DataFrame, columns: list[str], label: str, refits: DataFrame, alpha: float, window: int, key: str = "ts_code") -> DataFrame:
    """(key, fits): the fits of sliding_ridge() of each key that has rows, in one array.

    Dates are cut where a window begins or ends. Rows are summed by key and block of dates; a refit's sums are the
    difference of two running sums of blocks, which are at most two for each refit. A key's blocks are one row, and a
    task solves many keys at once. `refits` has refit_date.
    """
    p = len(columns)
    dates = samples.filter("label_end IS NOT NULL").groupBy("trade_date").agg(F.max("label_end").alias("__end"))
    dates = dates.withColumn("__i", F.row_number().over(Window.orderBy("trade_date")))
    bounds = refits.select("refit_date").distinct().join(dates, F.col("__end") < F.col("refit_date")).groupBy("refit_date").agg(F.max("__i").alias("__to"))
    bounds = bounds.withColumn("__from", F.greatest(F.col("__to") - window, F.lit(0)))
    edges = bounds.select(F.explode(F.array("__from", "__to")).alias("__edge")).distinct()
    cut = edges.withColumn("__block", F.row_number().over(Window.orderBy("__edge")) - 1)
    # block b holds the dates after edge b - 1, up to edge b
    placed = dates.select("trade_date", "__i").join(cut, F.col("__edge") >= F.col("__i")).groupBy("trade_date").agg(F.min("__block").alias("__block"))
    rows = samples.filter("label_end IS NOT NULL").join(F.broadcast(placed), "trade_date")  # as long as the calendar
    names = [*columns, label]
    whole = rows.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in names]))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    blocks = whole.groupBy(key, "__block").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in names], *products).alias("sums"))
    ends = cut.withColumnsRenamed({"__edge": "__e", "__block": "__b"})
    spans = bounds.join(ends, F.col("__from") == F.col("__e")).withColumnRenamed("__b", "__lo").drop("__e").join(ends, F.col("__to") == F.col("__e")).select("refit_date", "__lo", F.col("__b").alias("__hi"))
    wanted = spans.agg(F.sort_array(F.collect_list(F.struct("refit_date", "__lo", "__hi"))).alias("__spans"))
    kind = samples.schema[key].dataType.simpleString()

    fit = "array<struct<refit_date:date,n:bigint,intercept:double,coefficients:array<double>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                own = batch.slice(start, 1000)
                spans = own.column(2)[0].as_py()
                held, cells = own.column(1).value_lengths().to_numpy(), own.column(1).flatten()
                symbol, block = np.repeat(np.arange(own.num_rows), held), cells.field("__block").to_numpy()
                size = max(s["__hi"] for s in spans) + 2
                per = np.zeros((own.num_rows, size, 1 + (p + 1) + (p + 1) * (p + 2) // 2))
                per[symbol, block + 1, 0] = cells.field("n").to_numpy()
                per[symbol, block + 1, 1:] = cells.field("sums").flatten().to_numpy().reshape(len(symbol), -1)
                run_ = np.cumsum(per, axis=1)
                out = [[] for _ in range(own.num_rows)]
                for s in spans:
                    sums = run_[:, s["__hi"] + 1] - run_[:, s["__lo"] + 1]
                    enough = np.flatnonzero(np.round(sums[:, 0]) >= p + 2)
                    sums, n = sums[enough], np.round(sums[enough, 0])
                    full = np.zeros((len(enough), p + 1, p + 1))
                    upper = np.triu_indices(p + 1)
                    full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = sums[:, p + 2 :]
                    mean = sums[:, 1 : p + 2] / n[:, None]
                    centred = full - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
                    w = np.linalg.solve(centred[:, :p, :p] + alpha * np.eye(p), centred[:, :p, p:])[:, :, 0]
                    intercept = mean[:, p] - (mean[:, :p] * w).sum(1)
                    for i, k, b, c in zip(enough.tolist(), n.tolist(), intercept.tolist(), w.tolist(), strict=True):
                        out[i].append({"refit_date": s["refit_date"], "n": int(k), "intercept": b, "coefficients": c})
                kind_ = pa.list_(pa.struct([("refit_date", pa.date32()), ("n", pa.int64()), ("intercept", pa.float64()), ("coefficients", pa.list_(pa.float64()))]))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(out, kind_)], names=[key, "fits"])

    of_key = blocks.groupBy(key).agg(F.collect_list(F.struct("__block", "n", "sums")).alias("__blocks"))
    return of_key.join(F.broadcast(wanted.filter(F.size("__spans") > 0))).mapInArrow(run, f"{key} {kind}, fits {fit}")  # one row
