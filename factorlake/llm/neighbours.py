"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are made distinct, dealt into shards of bounded size, and each shard gets a graph: every vector is on
layer 0, and on each higher layer a sixteenth of those below. On each layer a vector is linked to near ones
that are diverse, links go both ways, and they are stored as one flat array of places. A query goes down from
the top layer and then keeps the best EF places on layer 0; all queries of a block go forward together. Each
shard answers each block of queries, and answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS, BLOCK_ROWS = 4096, 512
LINKS, WIDER, EF, RATIO = 24, 64, 64, 16


def usable(vector: str) -> Column:
    """Not null, not all zero, without components that are null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def diverse(vectors: np.ndarray, own: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """For each of the places `own`, up to `links` of its candidates `near` (nearest first, -1 for none): one is
    taken if it is nearer to the place than to all taken before; free room is then filled with the nearest left."""
    n, width = near.shape
    out = np.full((n, links), -1, np.int32)
    taken = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    valid = near >= 0
    mine = np.einsum("nd,nwd->nw", vectors[own], vectors[near])
    closest = np.full((n, width), -np.inf, np.float32)  # to those taken
    for w in range(width):
        ok = valid[:, w] & (count < links) & (mine[:, w] > closest[:, w])
        rows = np.flatnonzero(ok)
        if len(rows):
            out[rows, count[rows]] = near[rows, w]
            count[rows] += 1
            taken[rows, w] = True
            closest[rows] = np.maximum(closest[rows], np.einsum("nd,nwd->nw", vectors[near[rows, w]], vectors[near[rows]]))
    for w in range(width):
        rows = np.flatnonzero(valid[:, w] & ~taken[:, w] & (count < links))
        out[rows, count[rows]] = near[rows, w]
        count[rows] += 1
    return out


def layer_links(vectors: np.ndarray, places: np.ndarray, links: int) -> np.ndarray:
    """Flat neighbour array (len(vectors) x links, -1 for none) of a layer over the given places."""
    out = np.full((len(vectors), links), -1, np.int32)
    if len(places) < 2:
        return out
    width = min(WIDER, len(places) - 1)
    near = np.empty((len(places), width), np.int64)
    own = vectors[places]
    for a in range(0, len(places), 256):
        like = own[a : a + 256] @ own.T
        like[np.arange(len(like)), np.arange(a, a + len(like))] = -np.inf
        top = np.argpartition(-like, width - 1, axis=1)[:, :width]
        near[a : a + 256] = places[np.take_along_axis(top, np.argsort(-np.take_along_axis(like, top, 1), axis=1, kind="stable"), 1)]
    half = max(1, links // 2)
    for a in range(0, len(places), 256):
        out[places[a : a + 256], :half] = diverse(vectors, places[a : a + 256], near[a : a + 256], half)
    # links back: each place takes those that point at it, nearest first, as far as there is room
    source, target = np.repeat(places, half), out[places, :half].ravel()
    new = (target >= 0) & ~(out[target, :half] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    like = np.einsum("nd,nd->n", vectors[source], vectors[target])
    order = np.lexsort((-like, target))
    source, target = source[order], target[order]
    turn = np.arange(len(target)) - np.searchsorted(target, target, "left")
    room = turn < links - half
    out[target[room], half + turn[room]] = source[room]
    return out


def build_graph(vectors: np.ndarray, seed: int = 5) -> tuple[np.ndarray, list[int]]:
    """(all layers' neighbour arrays one after another, places on each layer): layer 0 has 2 * LINKS links a
    place, the others LINKS. Places are in a random order, so a layer holds the first ones."""
    sizes = [len(vectors)]
    while sizes[-1] > RATIO * 4:
        sizes.append(sizes[-1] // RATIO)
    made = [layer_links(vectors, np.arange(size), LINKS * (2 if level == 0 else 1))[:size].ravel() for level, size in enumerate(sizes)]
    return np.concatenate(made) if len(vectors) else np.zeros(0, np.int32), sizes


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, nearness), best first, of the best `ef` places found for each query; -1 for none.

    Every round each unfinished query opens its best unopened place; it ends when none of its best is unopened.
    """
    n, n_places = len(queries), len(vectors)
    best = np.full((n, ef), -1, np.int64)
    like = np.full((n, ef), -np.inf, np.float32)
    opened = np.ones((n, ef), bool)
    met = np.zeros((n, n_places), bool)
    width = entry.shape[1]
    best[:, :width] = entry
    like[:, :width] = np.where(entry >= 0, np.einsum("nd,nwd->nw", queries, vectors[entry]), -np.inf)
    opened[:, :width] = entry < 0
    met[np.nonzero(entry >= 0)[0], entry[entry >= 0]] = True
    live = np.arange(n)
    while len(live):
        unopened = np.where(opened[live], -np.inf, like[live])
        at = unopened.argmax(axis=1)
        going = unopened[np.arange(len(live)), at] > -np.inf
        live, at = live[going], at[going]
        if not len(live):
            break
        opened[live, at] = True
        next_ = links[best[live, at]]
        fresh = (next_ >= 0) & ~met[live[:, None], np.maximum(next_, 0)]
        met[live[:, None], np.maximum(next_, 0)] |= fresh
        score = np.where(fresh, np.einsum("nd,nwd->nw", queries[live], vectors[next_]), -np.inf).astype(np.float32)
        every = np.hstack((like[live], score))
        top = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
        like[live] = np.take_along_axis(every, top, 1)
        best[live] = np.take_along_axis(np.hstack((best[live], np.where(fresh, next_, -1))), top, 1)
        opened[live] = np.take_along_axis(np.hstack((opened[live], ~fresh)), top, 1)
    order = np.argsort(-like, axis=1, kind="stable")
    return np.take_along_axis(best, order, 1), np.take_along_axis(like, order, 1)


def single(vectors: np.ndarray, each: bool = False) -> np.ndarray:
    """Single precision after scaling by a power of two, one for all vectors or one for each, that puts the largest
    component at 2**55: finite doubles of any size neither overflow nor vanish in products, and what is largest stays so."""
    most = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0) if each else np.abs(vectors).max(initial=0.0)
    return np.ldexp(vectors, 55 - np.frexp(most)[1]).astype(np.float32)


def search_graph(vectors: np.ndarray, flat: np.ndarray, sizes: list[int], queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """Places of the best found for each query, best first, -1 for none."""
    starts = np.cumsum([0, *[s * LINKS * (2 if i == 0 else 1) for i, s in enumerate(sizes)]])
    entry = np.repeat(np.arange(min(sizes[-1], 8))[None, :], len(queries), axis=0)
    for level in range(len(sizes) - 1, -1, -1):
        links = flat[starts[level] : starts[level + 1]].reshape(sizes[level], -1)
        found = search_layer(vectors[: sizes[level]], links, queries, entry, ef if level == 0 else 16)[0]
        entry = found[:, :8]
    return found


def index_vectors(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: shard, dim, places (numbers of the vectors), vectors, links, sizes. `distinct`
    has (vec, number, dim); numbers are hashes, so shards are even."""
    shards = {r["dim"]: max(1, -(-r["n"] // shard_rows)) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    of = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]) if shards else None
    shard = F.pmod("number", F.get(F.array(F.element_at(of, F.col("dim"))), F.lit(0))) if shards else F.lit(0).cast("long")

    def build(table: pa.Table) -> pa.Table:
        numbers = table.column("number").to_numpy()
        vectors = single(np.array(table.column("vec").to_pylist(), np.float64))
        order = np.argsort(numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        numbers, vectors = numbers[order], vectors[order]
        links, sizes = build_graph(vectors)
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "dim": pa.array([vectors.shape[1]], pa.int32()), "numbers": pa.array([numbers.tolist()], pa.list_(pa.int64())),
            "vectors": pa.array([vectors.tobytes()], pa.binary()), "links": pa.array([links.astype("<i4").tobytes()], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
        })

    dealt = distinct.withColumn("shard", shard.cast("long")).repartition(max(1, sum(shards.values())), "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInArrow(build, "shard long, dim int, numbers array<long>, vectors binary, links binary, sizes array<int>")


def answers(index: DataFrame, blocks: DataFrame, k: int, ef: int = EF) -> DataFrame:
    """(query number, number): each shard's `k` best for each query of each block.

    Every block is sent to every shard, and a shard takes blocks one after another: a task's memory is one
    shard's graph and one block.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
                numbers = np.array(row["numbers"], np.int64)
                queries = single(np.array(row["queries"], np.float64).reshape(-1, row["dim"]), each=True)
                found = search_graph(vectors, np.frombuffer(row["links"], "<i4"), row["sizes"], queries, ef)[:, :k]
                asked = np.repeat(np.array(row["asked"], np.int64), found.shape[1])
                keep = found.ravel() >= 0
                yield pa.RecordBatch.from_arrays([pa.array(asked[keep]), pa.array(numbers[found.ravel()[keep]])], names=["asked", "number"])

    places = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    sent = blocks.join(F.broadcast(places), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    n = max(1, index.count())
    joined = index.repartition(n, "dim", "shard").join(sent.repartition(n, "dim", "shard"), ["dim", "shard"])
    return joined.select("dim", "numbers", "vectors", "links", "sizes", "asked", "queries").mapInArrow(run, "asked long, number long")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key `every` divides, the `k` nearest found of all
    other rows, by inner product in double precision, ties to the smaller key.

    Equal vectors are one place in a graph, and of their rows the k + 1 smallest keys are kept for answers: no
    query can have more of them among its k, itself excepted. Vectors that are null, zero or hold null or
    non-finite components, and rows with a null key, take no part; vectors of other lengths are not compared.
    Finite components may be of any size: graphs are searched in scaled single precision, scores are of the original
    vectors. Rows that share a key and a vector count once. An empty table gives an empty result.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), doubles.alias("vec")).filter(F.col("id").isNotNull() & usable("vec"))
    numbered = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).withColumn("number", F.xxhash64("vec"))
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    some = numbered.select("number", "id", salt.alias("salt")).distinct()
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("number", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
    members = cut(first.withColumn("n", F.row_number().over(Window.partitionBy("number").orderBy("id"))).filter(F.col("n") <= k + 1).select("number", "id"))
    distinct = cut(numbered.groupBy("number").agg(F.any_value("vec").alias("vec")).withColumn("dim", F.size("vec")))
    index = cut(index_vectors(distinct, shard_rows))
    asking = numbered.filter(F.col("id") % every == 0).select("id", "number", "vec").dropDuplicates(["id", "number"])
    asked = cut(asking.groupBy("number").agg(F.any_value("vec").alias("vec")).withColumn("dim", F.size("vec")))
    n_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    blocks = asked.groupBy("dim", F.pmod(F.xxhash64("number"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("number", "vec")).alias("q"))
    blocks = blocks.select("dim", F.col("q.number").alias("asked"), F.flatten("q.vec").alias("queries"))
    found = answers(index, blocks, k + 1, ef)
    vectors = distinct.select(F.col("number").alias("n2"), F.col("vec").alias("vec2"))
    scored = found.join(asked.select("number", "vec").withColumnRenamed("number", "asked"), "asked").join(vectors, F.col("number") == F.col("n2"))
    scored = scored.select("asked", "number", dot("vec", "vec2").alias("score"))
    near = scored.withColumn("n", F.rank().over(Window.partitionBy("asked").orderBy(F.desc("score")))).filter(F.col("n") <= k + 1).drop("n")
    queries = asking.select(F.col("id").alias("query_id"), F.col("number").alias("asked"))
    each = queries.join(near, "asked").join(members, "number").filter("id <> query_id")
    each = each.groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
