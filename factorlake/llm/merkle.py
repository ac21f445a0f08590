"""Merkle manifest of a table: a tree of digests for each group, a tree over the groups' roots, and octopus multiproofs.

Leaves are numbered within their group by a sort over all partitions. Trees grow from the leaves in steps of BLOCK_BITS
levels: a task gets an aligned block of nodes and makes the levels above it; so a tree of n leaves takes a job for each
BLOCK_BITS bits of n. All nodes are kept by their coordinates (tree, level, number).

Proofs are made by partitions of leaves (the rows of a block that are asked for, any number of them). A partition
computes from its leaves' numbers alone the union of the nodes that their proofs need and that can't be derived from the
leaves themselves, which is the least that it has to be given; all partitions fetch theirs by one join; each then
derives the interior nodes that its proofs share and spells out the proofs of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order

BLOCK_BITS = 12
#: The tree over the groups' roots; groups have trees 0, 1, ...
TOP = -1
NODE = "tree long, level int, number long, digest string, leaves long"
NODE_ARROW = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("number", pa.int64()), ("digest", pa.string()), ("leaves", pa.int64())])


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' count, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def sha256(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def nodes_at(leaves: int, level: int) -> int:
    return -(-leaves >> level)


def height(leaves: int) -> int:
    """Levels above the leaves: as long as there are several nodes."""
    return (leaves - 1).bit_length()


def missing(numbers: Iterable[int], leaves: int) -> list[tuple[int, int]]:
    """(level, number) of all nodes that proofs of the leaves `numbers` need besides what these leaves give."""
    found, own = [], sorted(set(numbers))
    for level in range(height(leaves)):
        here, count = set(own), nodes_at(leaves, level)
        found += [(level, i ^ 1) for i in own if i ^ 1 not in here and i ^ 1 < count]
        own = sorted({i >> 1 for i in own})
    return found


def derive(known: dict[int, str], given: dict[tuple[int, int], str], leaves: int) -> dict[int, str]:
    """The proof of each of the leaves `known`: the siblings on its way up, bottom first. What is above the leaves is
    hashed once for all of them; the other nodes are `given`, by level and number."""
    here, sides = known, []
    for level in range(height(leaves)):
        count, above, beside = nodes_at(leaves, level), {}, {}
        for i, digest in here.items():
            sibling = i ^ 1
            other = (here.get(sibling) or given[level, sibling]) if sibling < count else ""
            beside[i] = other
            if i >> 1 not in above:
                above[i >> 1] = sha256(digest, other) if i < sibling else sha256(other, digest)
        here = above
        sides.append(beside)
    proofs = {i: "" for i in here}
    for beside in reversed(sides):
        proofs = {i: side + proofs[i >> 1] for i, side in beside.items()}
    return proofs


def fold(digest: str, number: int, leaves: int, proof: str, known: dict[tuple[str, str], str]) -> str:
    """The root that a leaf and its siblings give. `known`: digests of pairs hashed before."""
    at = 0
    for level in range(height(leaves)):
        i = number >> level
        if i ^ 1 < nodes_at(leaves, level):
            other = proof[at : at + 64]
            at += 64
            pair = (digest, other) if i % 2 == 0 else (other, digest)
        else:
            pair = (digest, "")
        digest = known.get(pair) or known.setdefault(pair, sha256(*pair))
    return digest


def spans_of(rows: DataFrame, group: list[str]) -> DataFrame:
    """A row for each partition of in_order() and each group in it: what to add to __row for a number within the group,
    and the group's rows."""
    spans = rows.groupBy("__part", *group).agg(F.min("__row").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")
    return spans.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in group], shift.alias("__shift"), F.sum("__rows").over(whole).alias("leaves"))


def with_spans(rows: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    numbered = rows.join(spans, same).withColumn("number", F.col("__row") + F.col("__shift"))
    return numbered.drop("__row", "__part", "__p", "__shift", *[f"__g_{c}" for c in group])


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees over `leaves` (tree, number, digest, leaves): NODE's columns, the leaves being level 0."""
    base = cut(leaves.select("tree", F.lit(0).alias("level"), "number", "digest", "leaves"))
    most = base.agg(F.max("leaves")).first()[0] or 0

    def climb(table):
        rows = table.sort_by("number").to_pydict()
        tree, n, start, first = (rows[c][0] for c in ("tree", "leaves", "level", "number"))
        row, made = rows["digest"], {c: [] for c in ("tree", "level", "number", "digest", "leaves")}
        for level in range(start, min(start + BLOCK_BITS, height(n))):
            row = [sha256(*row[k : k + 2]) for k in range(0, len(row), 2)]
            first >>= 1
            for c, values in (("tree", [tree] * len(row)), ("level", [level + 1] * len(row)), ("number", range(first, first + len(row))), ("digest", row), ("leaves", [n] * len(row))):
                made[c] += values
        return pa.table(made, NODE_ARROW)

    levels, every = 0, [base]
    while height(most) > levels:
        below = every[-1].filter(F.col("level") == levels)
        every.append(cut(below.groupBy("tree", F.shiftright("number", BLOCK_BITS).alias("__block")).applyInArrow(climb, NODE)))
        levels += BLOCK_BITS
    made = every[0]
    for more in every[1:]:
        made = made.unionByName(more)
    return made


def manifest(df: DataFrame, digest: str, by: list[str], group: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` as numbered leaves, and all nodes of their trees and of the tree over the trees' roots.

    Leaves: the columns of `df` with tree, number, leaves (its tree's count) and top (all trees' count). Trees are
    numbered by `group`, nulls first, strings by their UTF-8 bytes; leaves within by `by`, nulls first, and then by
    their digests, so that rows that tie in all are alike. Nodes: NODE's columns. Columns tree, number, leaves and top of
    `df` are replaced; an empty table gives two empty tables. A group of any size spreads over partitions; joins of the
    leaves are by partition and group.
    """
    rows = in_order(cut(df.drop("tree", "number", "leaves", "top")), group, *by, digest)
    spans = cut(spans_of(rows, [group]))
    groups = in_order(spans.groupBy(F.col(f"__g_{group}").alias("group")).agg(F.max("leaves").alias("__n")), "group")
    trees = cut(with_spans(groups, spans_of(groups, []), []).select(F.col("group").alias("__g"), F.col("number").alias("tree"), F.col("leaves").alias("top")))
    spans = spans.join(trees, F.col(f"__g_{group}").eqNullSafe(F.col("__g"))).drop("__g")
    rows = cut(with_spans(rows, spans, [group]))
    nodes = grow(rows.select("tree", "number", F.col(digest).alias("digest"), "leaves"))
    roots = nodes.filter("leaves <= shiftleft(1L, level)").select(F.col("tree").alias("number"), "digest")
    tops = roots.join(trees.select(F.col("tree").alias("number"), F.col("top").alias("leaves")), "number")
    return rows, nodes.unionByName(grow(tops.withColumn("tree", F.lit(TOP).cast("long"))))


def prove(rows: DataFrame, nodes: DataFrame, digest: str, claimed: str, key: str) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded, verified) for each of `rows`, any of the leaves of manifest().

    `proof`: the siblings' digests on the way up to the root, one after another. `folded`: the root that the digest in
    the column `claimed` gives with these siblings; `verified`: whether that is the root of the manifest. A node is
    fetched at most once for each block of 2**BLOCK_BITS leaves; a task holds one block's leaves and proofs.
    """
    asked = rows.withColumn("__block", F.shiftright("number", BLOCK_BITS))
    place = ["tree", "__block"]
    wanted_type = pa.schema([("tree", pa.int64()), ("__block", pa.int64()), ("of", pa.int64()), ("level", pa.int32()), ("number", pa.int64())])

    def ask(table):
        own = table.to_pydict()
        tree, block, n, top = (own[c][0] for c in (*place, "leaves", "top"))
        wanted = [(tree, *x) for x in missing(own["number"], n)] + [(TOP, *x) for x in missing([tree], top)]
        wanted += [(tree, height(n), 0), (TOP, height(top), 0)]  # the published roots
        return pa.Table.from_pylist([dict(zip(wanted_type.names, (tree, block, *x), strict=True)) for x in wanted], wanted_type)

    requests = asked.select(*place, "number", "leaves", "top").groupBy(*place).applyInArrow(ask, "tree long, __block long, of long, level int, number long")
    had = nodes.select(F.col("tree").alias("of"), "level", "number", F.col("digest").alias("given"))
    fetched = requests.join(had, ["of", "level", "number"])
    names = ["key", "leaf", "subroot", "root", "proof", "folded", "verified"]

    def expand(table, given):
        kinds = [table.schema.field("key").type, *[pa.string()] * 5, pa.bool_()]
        own, kept = table.to_pydict(), given.to_pydict()
        made: list[list] = [[] for _ in names]
        if own["number"]:
            tree, n, top = (own[c][0] for c in ("tree", "leaves", "top"))
            of: dict[int, dict[tuple[int, int], str]] = {tree: {}, TOP: {}}
            for t, level, i, d in zip(kept["of"], kept["level"], kept["number"], kept["given"], strict=True):
                of[t][level, i] = d
            subroot, root = of[tree][height(n), 0], of[TOP][height(top), 0]
            proofs = derive(dict(zip(own["number"], own["leaf"], strict=True)), of[tree], n)
            upper = derive({tree: subroot}, of[TOP], top)[tree]
            known: dict[tuple[str, str], str] = {}
            for k, i, leaf, said in zip(own["key"], own["number"], own["leaf"], own["said"], strict=True):
                folded = fold(fold(said, i, n, proofs[i], known), tree, top, upper, known)
                for column, value in zip(made, (k, leaf, subroot, root, proofs[i] + upper, folded, folded == root), strict=True):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names)

    own = asked.select(*place, "number", "leaves", "top", F.col(key).alias("key"), F.col(digest).alias("leaf"), F.col(claimed).alias("said"))
    kind = rows.schema[key].dataType.simpleString()
    return own.groupBy(*place).cogroup(fetched.groupBy(*place)).applyInArrow(
        expand, f"key {kind}, leaf string, subroot string, root string, proof string, folded string, verified boolean"
    )
