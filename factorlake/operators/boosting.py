"""Boosted regression trees grown leaf by leaf from histograms, and stored trees applied to rows.

Columns are cut into bins by exact quantiles once. Leaves are split in the order of their gains until the tree has all
its leaves. A split's gain doesn't depend on that order, so the histograms of all leaves that the order has reached so
far, sums of gradients and counts by leaf, column and bin, are one aggregate; the order is then followed further, until
nothing that it reaches is unknown. A tree of seven leaves takes some four jobs for six splits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .quantiles import quantiles

#: Rows whose column is at most the threshold go left, rows that lack it by missing_left; a leaf has a value.
NODE = "column:int,threshold:double,left:int,right:int,missing_left:boolean,leaf:boolean,value:double"
MODEL = f"baseline double, depth int, trees array<array<struct<{NODE}>>>"


@dataclass
class Split:
    gain: float
    column: int
    bin: int
    missing_left: bool
    left: tuple[float, int]
    right: tuple[float, int]


@dataclass
class Node:
    """A node being grown: its gradients' sum and count, and once its histogram is known the best split, if any gains."""

    total: tuple[float, int] = (0.0, 0)
    split: Split | None = None
    known: bool = False
    children: tuple[int, int] | None = None


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node()])

    def order(self, leaves: int) -> list[int]:
        """The nodes to split, best gain first (ties: the older node), as far as histograms are known."""
        heap = [(-self.nodes[0].split.gain, 0)] if self.nodes[0].split else []
        out: list[int] = []
        while heap and len(out) + 1 < leaves:
            k = heapq.heappop(heap)[1]
            out.append(k)
            for child in self.nodes[k].children or ():
                if self.nodes[child].split:
                    heapq.heappush(heap, (-self.nodes[child].split.gain, child))
        return out

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node that each row of bins has come to."""
        at = np.zeros(len(bins), np.int32)
        for k, node in enumerate(self.nodes):  # children come after their parents
            if node.children:
                own = np.flatnonzero(at == k)
                x = bins[own, node.split.column]
                left = (x <= node.split.bin) & ((x >= 0) | node.split.missing_left)
                at[own] = np.where(left, *node.children)
        return at

    def table(self, splits: set[int], points: list[list[float]], value) -> list[tuple]:
        """NODE rows of the tree that has these splits, the root first."""
        order, at = [0], 0
        while at < len(order):
            order += self.nodes[order[at]].children if order[at] in splits else ()
            at += 1
        number = {k: i for i, k in enumerate(order)}
        rows = []
        for k in order:
            node = self.nodes[k]
            if k in splits:
                s = node.split
                rows.append((s.column, threshold(points[s.column], s.bin), number[node.children[0]], number[node.children[1]], s.missing_left, False, 0.0))
            else:
                rows.append((-1, 0.0, -1, -1, False, True, float(value(node.total))))
        return rows


def threshold(points: list[float], b: int) -> float:
    """What values of the bins up to `b` are at most; all values where `b` is the last bin, so that only missing ones are more."""
    return points[b] if b < len(points) else math.inf


def best_split(cells: dict[int, dict[int, tuple[float, int]]], l2: float, least: int) -> Split | None:
    """The split of a leaf that lowers the loss most, from sums and counts by column and bin (bin -1: missing); None if none
    gains. Of equals the first column, then the lowest bin, then missing values to the left."""
    best = None
    score = lambda part: part[0] ** 2 / (part[1] + l2)
    for column in sorted(cells):
        bins = cells[column]
        missing = bins.get(-1, (0.0, 0))
        total = (sum(s for s, _ in bins.values()), sum(n for _, n in bins.values()))
        s, n = 0.0, 0
        for b in sorted(k for k in bins if k >= 0):
            s, n = s + bins[b][0], n + bins[b][1]
            for to_left in (True, False) if missing[1] else (False,):
                left = (s + missing[0], n + missing[1]) if to_left else (s, n)
                right = (total[0] - left[0], total[1] - left[1])
                if min(left[1], right[1]) >= least:
                    gain = score(left) + score(right) - score(total)
                    if gain > 1e-12 and (best is None or gain > best.gain * (1 + 1e-9)):
                        best = Split(gain, column, b, to_left, left, right)
    return best


CHUNK = "bins binary, gradients binary"


def chunks(df: DataFrame, columns: int) -> DataFrame:
    """CHUNK rows of (bins of all columns, gradient): each batch of rows as two arrays."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            bins = np.column_stack([batch.column(k).to_numpy() for k in range(columns)]).astype(np.int16)
            gradients = batch.column(columns).to_numpy().astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([gradients.tobytes()], pa.binary())], names=["bins", "gradients"])

    return df.mapInArrow(pack, CHUNK)


def unpacked(rows: Iterator[pa.RecordBatch], columns: int, trees: list[tuple[Tree, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and gradients of each chunk; what these trees, with the values of their nodes, add to the gradients is added."""
    for batch in rows:
        for bins, gradients in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, g = np.frombuffer(bins, np.int16).reshape(-1, columns), np.frombuffer(gradients).copy()
            for tree, values in trees:
                g += values[tree.place(x)]
            yield x, g


def histograms(rows: DataFrame, columns: int, bins: int, trees: list[tuple[Tree, np.ndarray]], tree: Tree, nodes: list[int]) -> dict[int, dict[int, dict[int, tuple[float, int]]]]:
    """Sums of the gradients and counts by node, column and bin, of the given nodes. A task adds up its own chunks first;
    the driver gets a row for each cell."""
    width = bins + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(len(tree.nodes), -1)
        number[nodes] = np.arange(len(nodes))
        size = len(nodes) * columns * width
        sums, counts = np.zeros(size), np.zeros(size, np.int64)
        for x, g in unpacked(batches, columns, trees):
            own = number[tree.place(x)]
            held = own >= 0
            for j in range(columns):
                cell = (own[held] * columns + j) * width + x[held, j] + 1
                sums += np.bincount(cell, g[held], size)
                counts += np.bincount(cell, minlength=size)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there]), pa.array(counts[there])], names=["cell", "s", "n"])

    out: dict[int, dict[int, dict[int, tuple[float, int]]]] = {k: {} for k in nodes}
    for r in rows.mapInArrow(add, "cell int, s double, n long").groupBy("cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        place, b = divmod(r["cell"], width)
        node, column = divmod(place, columns)
        out[nodes[node]].setdefault(column, {})[b - 1] = (r["s"], r["n"])
    return out


def grow(rows: DataFrame, columns: int, bins: int, before: list[tuple[Tree, np.ndarray]], leaves: int, l2: float, least: int) -> tuple[Tree, set[int]]:
    """One tree for the gradients of `rows` with those that the trees `before` add, and its split nodes."""
    tree, asked = Tree(), [0]
    while asked:
        found = histograms(rows, columns, bins, before, tree, asked)
        for k in asked:
            node = tree.nodes[k]
            if k == 0 and found[0]:
                first = found[0][0].values()
                node.total = (sum(s for s, _ in first), sum(n for _, n in first))
            node.split, node.known = best_split(found[k], l2, least), True
        splits = tree.order(leaves)
        for k in splits:
            node = tree.nodes[k]
            if node.children is None:
                node.children = (len(tree.nodes), len(tree.nodes) + 1)
                tree.nodes += [Node(node.split.left), Node(node.split.right)]
        # the last split of a full tree has children that aren't split, so their histograms aren't wanted
        open_ = splits if len(splits) + 1 < leaves else splits[:-1]
        asked = [c for k in open_ for c in tree.nodes[k].children if not tree.nodes[c].known]
    for k, node in enumerate(tree.nodes):
        if k not in splits:
            node.children = None
    return tree, set(splits)


def cut_points(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """For each column the values that part it into at most `bins` bins of near-equal rows: its quantiles, each value once,
    those under the greatest value."""
    wanted = {f"{i} {k}": (c, k / bins) for i, c in enumerate(columns) for k in range(1, bins)}
    highest = df.agg(*[F.max(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    found = quantiles(df, wanted).first()
    return [sorted({v for k in range(1, bins) if (v := found[f"{i} {k}"]) is not None and v < highest[i]}) for i in range(len(columns))]


def bin_of(c: str, points: list[float]) -> Column:
    """How many cut points lie below the value; -1 where there is none."""
    x = F.col(c).cast("double")
    count = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < x)) if points else F.lit(0)
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(count).cast("int")


def walk(tree: Column, values: Column, depth: Column) -> Column:
    """The value of the leaf of a stored tree that a row's array of values ends in."""

    def step(k: Column, _: Column) -> Column:
        node = F.get(tree, k)
        x = F.get(values, node["column"])
        left = F.when(x.isNull() | F.isnan(x), node["missing_left"]).otherwise(x <= node["threshold"])
        return F.when(node["leaf"], k).when(left, node["left"]).otherwise(node["right"])

    return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0), step))["value"]


def depth_of(tree: list[tuple]) -> int:
    """Steps from the root to the deepest leaf: children come after their parents."""
    depth = [0] * len(tree)
    for k, node in enumerate(tree):
        for child in () if node[5] else node[2:4]:
            depth[child] = depth[k] + 1
    return max(depth)


def fit_trees(train: DataFrame, columns: list[str], label: str, rounds: int = 60, leaves: int = 7, l2: float = 1.0, rate: float = 0.06, least: int = 20, bins: int = 64, every: int = 20) -> DataFrame:
    """One row of MODEL: boosted least squares. Each of `rounds` trees of at most `leaves` leaves fits what the ones before left
    over, is shrunk by `rate`, has at least `least` rows in a leaf and `l2` added to their number.

    Rows without a label don't count; a missing value is a bin of its own. Rows are kept as arrays of bins and gradients,
    which are brought up to date and written to the shared folder every so many trees, so that neither plans nor the work
    of a tree grow and lost executors cost little.
    What comes to the driver are histograms, at most leaves * columns * (bins + 1) rows at a time.
    """
    rows = train.filter(F.col(label).isNotNull())
    points = cut_points(rows, columns, bins)
    slim = rows.select(*[bin_of(c, p).alias(f"b{i}") for i, (c, p) in enumerate(zip(columns, points, strict=True))], F.col(label).cast("double").alias("y"))
    mean = slim.agg(F.avg("y")).first()[0]
    if mean is None:
        raise ValueError("no rows")
    p, trees, fresh = len(columns), [], []
    kept = chunks(slim.withColumn("y", F.lit(float(mean)) - F.col("y")), p).persist(StorageLevel.MEMORY_AND_DISK)
    for r in range(rounds):
        tree, splits = grow(kept, p, bins, fresh, leaves, l2, least)
        value = lambda total: -rate * total[0] / (total[1] + l2)
        trees.append(tree.table(splits, points, value))
        if not splits:  # nothing is left that a split could win
            break
        fresh.append((tree, np.array([value(n.total) for n in tree.nodes])))
        if len(fresh) == every and r + 1 < rounds:
            done, fresh = fresh, []

            def settle(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for x, g in unpacked(batches, p, done):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=["bins", "gradients"])

            moved = cut(kept.mapInArrow(settle, CHUNK)).persist(StorageLevel.MEMORY_AND_DISK)
            kept.unpersist()
            kept = moved
    kept.unpersist()
    return train.sparkSession.createDataFrame([(float(mean), max(map(depth_of, trees), default=0), trees)], MODEL)


def score_trees(df: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with the prediction of a stored model (one row of MODEL): the baseline and each tree's value. A row walks every tree
    in a column expression; a column that it lacks sends it the node's own way."""
    joined = df.crossJoin(F.broadcast(model.limit(1).select(F.col("baseline").alias("__b"), F.col("depth").alias("__d"), F.col("trees").alias("__t"))))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    made = joined.withColumn("__v", values).withColumn("prediction", F.aggregate("__t", F.col("__b"), lambda a, t: a + walk(t, F.col("__v"), F.col("__d"))))
    return made.drop("__b", "__d", "__t", "__v")


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], label: str, **params) -> DataFrame:
    """`test` with a prediction for every row; a missing column is the trees' own case."""
    return score_trees(test, fit_trees(train, columns, label, **params), columns)
