"""Exact quantiles of whole columns without any task seeing all their values.

A sketch of bounded size proposes a bracket around every wanted place; exact counts over all rows say whether the place
lies within, and narrow the bracket if it holds more than LEFT rows; what is left is counted by value. Places of one
column that share a bracket share its counts, so any number of quantiles of a column takes the passes of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a bracket that isn't narrowed any more, and the sketch's accuracy (its places are off by one in so many).
LEFT, ACCURACY = 100_000, 10_000


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], left: int = LEFT, accuracy: int = ACCURACY) -> DataFrame:
    """One row with a double for each name of `wanted` (column, share of rows below), interpolated linearly between the
    two nearest values. Nulls don't count; a column without values has null; NaN is the largest value.

    What comes to the driver is a row of counts a pass and two values for each name. Brackets shrink by the accuracy in
    each pass, so passes grow with the logarithm of the rows; a value that repeats is one row of the last count, so
    brackets of one value end the search as well. `df` is kept for the passes and released.
    """
    names = sorted({c for c, _ in wanted.values()})
    with_columns = Columns(df, names)
    try:
        ends = with_columns.ends()
        near = {w: neighbours(ends[c][0], share) for w, (c, share) in wanted.items() if ends[c][0]}
        values = with_columns.values({(wanted[w][0], k) for w, (low, high, _) in near.items() for k in (low, high)}, left, accuracy)
    finally:
        with_columns.release()
    found = {w: between(values[wanted[w][0], near[w][0]], values[wanted[w][0], near[w][1]], near[w][2]) if w in near else None for w in wanted}
    return one_row(df, found)


def neighbours(n: int, share: float) -> tuple[int, int, float]:
    """The two order statistics (from 0) of n values that a quantile lies between, and how far towards the second."""
    place = share * (n - 1)
    low = floor(place)
    return low, min(low + 1, n - 1), place - low


def between(low: float, high: float, share: float) -> float:
    return low if share == 0 or low == high else (1 - share) * low + share * high


def as_row(stats: DataFrame) -> DataFrame:
    """One row of doubles, computed now: the rows that it was made from aren't read again."""
    return one_row(stats, stats.first().asDict())


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.sparkSession.range(0, 1, 1, 1).select(*[F.lit(v).cast("double").alias(name) for name, v in values.items()])


class Columns:
    """Columns of doubles, kept for some passes."""

    def __init__(self, df: DataFrame, names: list[str]):
        self.names = names
        self.rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).persist(StorageLevel.MEMORY_AND_DISK)
        self._ends: dict[str, tuple[int, float, float]] | None = None

    def release(self) -> None:
        self.rows.unpersist()

    def ends(self) -> dict[str, tuple[int, float, float]]:
        """Each column's number of values, the least and the greatest; and under "" the number of rows."""
        if self._ends is None:
            found = self.rows.agg(F.count("*"), *[f(f"c{i}") for i in range(len(self.names)) for f in (F.count, F.min, F.max)]).first()
            self._ends = {c: tuple(found[1 + 3 * i : 4 + 3 * i]) for i, c in enumerate(self.names)} | {"": (found[0], None, None)}
        return self._ends

    def counts(self, wanted: set[tuple[str, float]]) -> dict[tuple[str, float], tuple[int, int]]:
        """For each (column, point) how many values are less, and how many at most the point; NaN is the largest value."""
        points = {self.names.index(c): np.unique([p for d, p in wanted if d == c]) for c, _ in wanted}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((2, len(p) + 1), np.int64) for k, p in points.items()}
            for batch in batches:
                for k, p in points.items():
                    x = batch.column(k).drop_null().to_numpy()
                    for i, side in enumerate(("right", "left")):  # below a point are the values after which it is the first
                        sums[k][i] += np.bincount(np.searchsorted(p, x, side), minlength=len(p) + 1)
            own = {k: m.cumsum(1)[:, :-1] for k, m in sums.items()}
            column = np.repeat(list(own), [m.shape[1] for m in own.values()]).astype(np.int32)
            place = np.concatenate([np.arange(m.shape[1], dtype=np.int32) for m in own.values()])
            less, upto = np.concatenate(list(own.values()), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(column), pa.array(place), pa.array(less), pa.array(upto)], names=["c", "k", "less", "upto"])

        rows = self.rows.mapInArrow(add, "c int, k int, less long, upto long").groupBy("c", "k").agg(F.sum("less").alias("less"), F.sum("upto").alias("upto")).collect()
        found = {(r["c"], r["k"]): (r["less"], r["upto"]) for r in rows}
        return {(c, p): found[k, int(np.searchsorted(points[k], p))] for c, p in wanted for k in [self.names.index(c)]}

    def values(self, wanted: set[tuple[str, int]], left: int = LEFT, accuracy: int = ACCURACY) -> dict[tuple[str, int], float]:
        """The values of (column, place): place 0 is the column's least."""
        x = lambda c: F.col(f"c{self.names.index(c)}")
        inside = lambda c, lo, hi: (x(c) >= F.lit(lo)) & (x(c) <= F.lit(hi))
        held = {(c, k): (self.ends()[c][1], self.ends()[c][2], 0, self.ends()[c][0]) for c, k in wanted}  # ends, rows below, rows within
        wide = {w for w, h in held.items() if h[3] > left and h[0] != h[1]}
        while wide:
            brackets: dict[tuple, list[tuple[str, int]]] = {}
            for w in sorted(wide):
                brackets.setdefault((w[0], *held[w]), []).append(w)
            asked = [(key, own, [min(1.0, max(0.0, (k - key[3]) / key[4] + s)) for _, k in own for s in (-2 / accuracy, 2 / accuracy)]) for key, own in brackets.items()]
            probes = self.rows.agg(*[F.percentile_approx(F.when(inside(*key[:3]), x(key[0])), F.array(*map(F.lit, shares)), accuracy) for key, _, shares in asked]).first()
            points = {w: (p[2 * i], p[2 * i + 1]) for (_, own, _), p in zip(asked, probes, strict=True) for i, w in enumerate(own)}
            order = sorted(wide)
            found = self.counts({(w[0], p) for w in order for p in points[w]})
            counts = [k for w in order for k in (found[w[0], points[w][0]][0], found[w[0], points[w][1]][1])]
            for i, w in enumerate(order):
                (lo, hi, below, n), (less, upto), k = held[w], counts[2 * i : 2 * i + 2], w[1]
                start = (points[w][0], less) if below <= less <= k else (lo, below)
                end = (points[w][1], upto) if k + 1 <= upto <= below + n else (hi, below + n)
                now = (start[0], end[0], start[1], end[1] - start[1])
                if now == held[w] or now[3] <= left or now[0] == now[1]:
                    wide.remove(w)
                held[w] = now
        groups: dict[tuple, list[int]] = {}
        for (c, k), (lo, hi, below, _) in held.items():
            groups.setdefault((c, lo, hi, below), []).append(k)
        if not groups:
            return {}
        order = list(groups)
        places = F.array(*[F.array(*[F.lit(k - g[3]).cast("long") for k in sorted(groups[g])]) for g in order])
        brackets_ = [(self.names.index(c), lo, hi) for c, lo, hi, _ in order]

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = {k: np.sort(batch.column(k).drop_null().to_numpy()) for k in {k for k, _, _ in brackets_}}
                own = [np.unique(x[k][np.searchsorted(x[k], lo) : np.searchsorted(x[k], hi, "right")], return_counts=True) for k, lo, hi in brackets_]
                number = np.repeat(np.arange(len(own), dtype=np.int32), [len(v) for v, _ in own])
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([v for v, _ in own])), pa.array(np.concatenate([n for _, n in own]).astype(np.int64))], names=["w", "v", "count"])

        cells = self.rows.mapInArrow(within, "w int, v double, count long").groupBy("w", "v").agg(F.sum("count").alias("count"))
        cells = cells.withColumns({"upto": F.sum("count").over(Window.partitionBy("w").orderBy("v")), "at": F.get(places, F.col("w"))})
        hit = F.filter("at", lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("count") <= k))
        out = {}
        for r in cells.withColumn("hit", hit).filter(F.size("hit") > 0).select("w", "v", "hit").collect():
            c, _, _, below = order[r["w"]]
            out |= {(c, k + below): r["v"] for k in r["hit"]}
        return out
