"""Factor columns: small expressions over a symbol's sessions and a day's symbols.

A Factor is built with Python functions and operators. evaluate() turns factors into columns: windows over a
symbol's sessions and windows over a day are made layer by layer, equal parts once, and everything between
them stays one expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
LONGEST = 252


@dataclass(frozen=True)
class Factor:
    op: str
    args: tuple[Factor, ...] = ()
    given: tuple = ()

    def __add__(self, other):
        return Factor("add", (self, as_factor(other)))

    def __radd__(self, other):
        return as_factor(other) + self

    def __sub__(self, other):
        return Factor("sub", (self, as_factor(other)))

    def __rsub__(self, other):
        return as_factor(other) - self

    def __mul__(self, other):
        return Factor("mul", (self, as_factor(other)))

    def __rmul__(self, other):
        return as_factor(other) * self

    def __truediv__(self, other):
        return Factor("div", (self, as_factor(other)))

    def __rtruediv__(self, other):
        return as_factor(other) / self

    def __neg__(self):
        return Factor("neg", (self,))

    def __pos__(self):
        return self

    @property
    def lookback(self) -> int:
        """Sessions before the current one that the factor looks at."""
        own = self.given[0] if self.op in ("lag",) else self.given[0] - 1 if OPS[self.op].kind == "symbol" else 0
        return own + max((a.lookback for a in self.args), default=0)

    @property
    def fields(self) -> set[str]:
        return {self.given[0]} if self.op == "field" else set().union(*(a.fields for a in self.args)) if self.args else set()


def as_factor(x) -> Factor:
    return x if isinstance(x, Factor) else Factor("lit", (), (float(x),))


@dataclass(frozen=True)
class Op:
    kind: str  # point, symbol (window over sessions) or day (window over symbols)
    column: Callable
    sql: Callable


def finite(x: Column) -> Column:
    """Null for null, NaN and infinities."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sessions() -> Window:
    return Window.partitionBy("ts_code").orderBy("trade_date")


def last(n: int) -> Window:
    return sessions().rowsBetween(-(n - 1), 0)


def whole_window(f: Callable) -> Callable:
    return lambda x, n: F.when(F.count(x).over(last(n)) == n, f(x).over(last(n)))


def _last_sql(n: int) -> str:
    return f"(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def whole_sql(f: str) -> Callable:
    return lambda x, n: f"CASE WHEN count({x}) OVER {_last_sql(n)} = {n} THEN {f}({x}) OVER {_last_sql(n)} END"


def day_rank(x: Column) -> Column:
    mine = Window.partitionBy("trade_date", x.isNotNull())
    return F.when(x.isNotNull(), (F.rank().over(mine.orderBy(x)) + (F.count(x).over(Window.partitionBy("trade_date", x)) - 1) / 2) / F.count(x).over(Window.partitionBy("trade_date")))


def day_zscore(x: Column) -> Column:
    day = Window.partitionBy("trade_date")
    return F.when(F.stddev_pop(x).over(day) > TINY, (x - F.avg(x).over(day)) / F.stddev_pop(x).over(day))


_DAY = "(PARTITION BY trade_date)"
OPS = {
    "field": Op("point", lambda name: finite(F.col(name).cast("double")), lambda name: f"CASE WHEN isfinite({name}) THEN {name} END"),
    "lit": Op("point", lambda v: F.lit(v), lambda v: f"{v!r}::DOUBLE"),
    "add": Op("point", lambda a, b: a + b, lambda a, b: f"({a} + {b})"),
    "sub": Op("point", lambda a, b: a - b, lambda a, b: f"({a} - {b})"),
    "mul": Op("point", lambda a, b: a * b, lambda a, b: f"({a} * {b})"),
    "neg": Op("point", lambda a: -a, lambda a: f"(-{a})"),
    "div": Op("point", lambda a, b: F.when(F.abs(b) > TINY, a / b), lambda a, b: f"(CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END)"),
    "log": Op("point", lambda a: F.when(a > 0, F.log(a)), lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) END)"),
    "sqrt": Op("point", lambda a: F.when(a >= 0, F.sqrt(a)), lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)"),
    "abs": Op("point", lambda a: F.abs(a), lambda a: f"abs({a})"),
    "sign": Op("point", lambda a: F.signum(a), lambda a: f"sign({a})::DOUBLE"),
    "clip": Op("point", lambda a, lo, hi: F.when(a.isNotNull(), F.least(F.greatest(a, F.lit(lo)), F.lit(hi))), lambda a, lo, hi: f"(CASE WHEN {a} IS NOT NULL THEN least(greatest({a}, {lo!r}), {hi!r}) END)"),
    "min2": Op("point", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)"),
    "max2": Op("point", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)"),
    "place": Op(
        "point",
        lambda x, values, n: F.when(F.size(values) == n, (F.size(F.filter(values, lambda v: v < x)) + (F.size(F.filter(values, lambda v: v == x)) + 1) / 2) / n),
        lambda x, values, n: f"(CASE WHEN len({values}) = {n} THEN (len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0) / {n} END)",
    ),
    "lag": Op("symbol", lambda x, n: F.lag(x, n).over(sessions()), lambda x, n: f"lag({x}, {n}) OVER (PARTITION BY ts_code ORDER BY trade_date)"),
    "ts_mean": Op("symbol", whole_window(F.avg), whole_sql("avg")),
    "ts_std": Op("symbol", whole_window(F.stddev_pop), whole_sql("stddev_pop")),
    "ts_min": Op("symbol", whole_window(F.min), whole_sql("min")),
    "ts_max": Op("symbol", whole_window(F.max), whole_sql("max")),
    "ts_sum": Op("symbol", whole_window(F.sum), whole_sql("sum")),
    "ts_values": Op("symbol", lambda x, n: F.collect_list(x).over(last(n)), lambda x, n: f"list({x}) FILTER ({x} IS NOT NULL) OVER {_last_sql(n)}"),
    "rank": Op("day", day_rank, lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, {x} IS NOT NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0) / count({x}) OVER {_DAY} END"),
    "zscore": Op("day", day_zscore, lambda x: f"CASE WHEN stddev_pop({x}) OVER {_DAY} > 1e-12 THEN ({x} - avg({x}) OVER {_DAY}) / stddev_pop({x}) OVER {_DAY} END"),
}


def _window(op: str, x, n: int, least: int = 1) -> Factor:
    if not least <= n <= LONGEST:
        raise ValueError(f"a window of {n} sessions is not between {least} and {LONGEST}")
    return Factor(op, (as_factor(x),), (n,))


def field(name: str) -> Factor:
    return Factor("field", (), (name,))


def lag(x, n: int) -> Factor:
    return _window("lag", x, n)


def delta(x, n: int) -> Factor:
    return as_factor(x) - lag(x, n)


def returns(x, n: int) -> Factor:
    return as_factor(x) / lag(x, n) - 1


def ts_mean(x, n: int) -> Factor:
    return _window("ts_mean", x, n)


def ts_std(x, n: int) -> Factor:
    return _window("ts_std", x, n)


def ts_min(x, n: int) -> Factor:
    return _window("ts_min", x, n)


def ts_max(x, n: int) -> Factor:
    return _window("ts_max", x, n)


def ts_sum(x, n: int) -> Factor:
    return _window("ts_sum", x, n)


def ts_rank(x, n: int) -> Factor:
    return Factor("place", (as_factor(x), _window("ts_values", x, n)), (n,))


def rank(x) -> Factor:
    return Factor("rank", (as_factor(x),))


def zscore(x) -> Factor:
    return Factor("zscore", (as_factor(x),))


def log(x) -> Factor:
    return Factor("log", (as_factor(x),))


def sqrt(x) -> Factor:
    return Factor("sqrt", (as_factor(x),))


def absolute(x) -> Factor:
    return Factor("abs", (as_factor(x),))


def sign(x) -> Factor:
    return Factor("sign", (as_factor(x),))


def clip(x, low: float, high: float) -> Factor:
    if not low < high:
        raise ValueError("clip needs low < high")
    return Factor("clip", (as_factor(x),), (float(low), float(high)))


def min2(x, y) -> Factor:
    return Factor("min2", (as_factor(x), as_factor(y)))


def max2(x, y) -> Factor:
    return Factor("max2", (as_factor(x), as_factor(y)))


def layers(factors: list[Factor]) -> list[list[Factor]]:
    """The window parts of all factors, each once: a layer's parts need earlier layers only."""
    depth: dict[Factor, int] = {}

    def of(f: Factor) -> int:
        below = max((of(a) for a in f.args), default=0)
        if OPS[f.op].kind == "point":
            return below
        depth.setdefault(f, below + 1)
        return depth[f]

    for f in factors:
        of(f)
    return [[f for f, d in depth.items() if d == level] for level in range(1, max(depth.values(), default=0) + 1)]


def evaluate(grid: DataFrame, factors: dict[str, Factor], directions: dict[str, int] | None = None, mask: bool = True) -> DataFrame:
    """`grid` with a column for each factor, times its direction; null where close is null (if `mask`) and where
    the value is not finite."""
    made: dict[Factor, str] = {}

    def column(f: Factor) -> Column:
        return F.col(made[f]) if f in made else OPS[f.op].column(*[column(a) for a in f.args], *f.given)

    out = grid
    for level in layers(list(factors.values())):
        new = {f"__f{len(made) + i}": f for i, f in enumerate(level)}
        out = out.withColumns({name: OPS[f.op].column(*[column(a) for a in f.args], *f.given) for name, f in new.items()})
        made |= {f: name for name, f in new.items()}
    final = {}
    for name, f in factors.items():
        value = finite(column(f)) * F.lit(float((directions or {}).get(name, 1)))
        final[name] = F.when(F.col("close").isNotNull(), value) if mask else value
    return out.withColumns(final).drop(*made.values())


def factor_sql(factors: dict[str, Factor], base: str = "grid", name: str = "factors", mask: bool = True, directions: dict[str, int] | None = None) -> str:
    """The same for DuckDB: common table expressions, one for each layer, that end in the table `name`."""
    made: dict[Factor, str] = {}

    def text(f: Factor) -> str:
        return made[f] if f in made else OPS[f.op].sql(*[text(a) for a in f.args], *f.given)

    parts = []
    for i, level in enumerate(layers(list(factors.values()))):
        new = {f"{name}_f{len(made) + j}": f for j, f in enumerate(level)}
        parts.append(f"{name}_{i} AS (SELECT *, {', '.join(f'{OPS[f.op].sql(*[text(a) for a in f.args], *f.given)} AS {n}' for n, f in new.items())} FROM {base})")
        made |= {f: n for n, f in new.items()}
        base = f"{name}_{i}"
    final = []
    for n, f in factors.items():
        x = text(f)
        guard = f"isfinite({x})" + " AND close IS NOT NULL" * mask
        final.append(f"CASE WHEN {guard} THEN {x} * {(directions or {}).get(n, 1)} END AS {n}")
    return ",\n".join([*parts, f"{name} AS (SELECT *, {', '.join(final)} FROM {base})"])
