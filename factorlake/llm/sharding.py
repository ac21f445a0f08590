"""Histogram sort into shards of near-equal bytes, with DataFrame functions only.

A row's 63-bit key is made of its text's hash (upper 40 bits) and its doc_id's hash (lower 23 bits), so
equal texts are neighbours, yet a group of copies of any size can be cut between its rows. Splitters
between shards are found by counting: the exact bytes below probe keys are summed over all partitions,
and only the intervals that hold a target are probed again, 256 times finer, until what is left in an
interval is within the tolerance or is a single row. Then the rows are exchanged once.

Rows that repeat in both text and doc_id share a key. Where a splitter falls inside such a key, its rows are written
out once with a random number each, and the same search goes on over these numbers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, utf8_bytes

KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 15, 8
#: Bytes of a piece, the rows that one task numbers, and how many pieces there are at most: their bounds are literals of
#: the plan. Beyond, pieces grow; sorting them spills.
PIECE_BYTES, MOST_PIECES = 64 << 20, 4096


def sort_key(text: str = "text", key: str = "doc_id") -> Column:
    by_text = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 24), 23)
    return by_text.bitwiseOR(F.shiftrightunsigned(F.xxhash64(key), 41))


class Inside(NamedTuple):
    """A splitter between rows of one key, with this many of the key's bytes before it."""

    key: int
    bytes: float


def find_splitters(keys: DataFrame, parts: int, tolerance: float, targets: list[float] | None = None) -> list[int | Inside]:
    """Keys that cut `keys` (columns k, size) into `parts` runs of near-equal bytes, or at the ascending `targets`, if given.

    A run's end misses its target by half of `tolerance` times a run, or by half of the bytes of the one row that the
    target falls into. Where rows of one key hold more bytes than the tolerance and the target is inside of them, an
    Inside is returned. The driver gets the cells of open intervals only: at most 2**15 in the first round and 256 for
    each splitter in later ones.
    """
    width = KEY_BITS - FIRST_BITS
    cells = [tuple(r) for r in keys.groupBy(F.shiftright("k", width).alias("c")).agg(F.sum("size"), F.count("*")).orderBy("c").collect()]
    total = sum(size for _, size, _ in cells)
    slack = tolerance * total / parts
    found: dict[int, int | Inside] = {}
    wanted = {j: total * j / parts for j in range(1, parts)} if targets is None else dict(enumerate(targets, 1))
    last_wanted = len(wanted)
    below: dict[int, int] = {0: 0}  # bytes below each open interval, by its first cell's prefix
    groups = {0: cells}
    owner = {j: 0 for j in wanted}
    while wanted:
        opened: dict[int, int] = {}
        into: dict[int, int] = {}
        for prefix, own in groups.items():
            at = below[prefix]
            targets = sorted((wanted[j], j) for j in owner if owner[j] == prefix)
            i = 0
            for n, (cell, size, rows) in enumerate(own):
                last = n == len(own) - 1
                while i < len(targets) and (targets[i][0] < at + size or last):
                    target, j = targets[i]
                    if width == 0 and rows > 1 and size > slack and at < target < at + size:
                        found[j] = Inside(cell, target - at)
                    elif rows == 1 or width == 0 or size <= slack:
                        found[j] = (cell << width) if target - at < at + size - target else ((cell + 1) << width)
                    else:
                        opened[cell], into[j] = at, cell
                    i += 1
                at += size
            for _, j in targets[i:]:  # an empty table
                found[j] = 0
        wanted = {j: t for j, t in wanted.items() if j not in found}
        if not wanted:
            break
        step = min(NEXT_BITS, width)
        rows = (
            keys.filter(F.shiftright("k", width).isin(list(opened)))
            .groupBy(F.shiftright("k", width - step).alias("c"))
            .agg(F.sum("size"), F.count("*"))
            .orderBy("c")
            .collect()
        )
        groups = {prefix: [] for prefix in opened}
        for c, size, n in rows:
            groups[c >> step].append((c, size, n))
        width, below, owner = width - step, opened, into
    return [found[j] for j in range(1, last_wanted + 1)]


TIE_BITS = 48


def find_ties(tied: DataFrame, cuts: list[int | Inside], slack: float) -> list[tuple[int, int]]:
    """The splitters as pairs (key, number within the key), from the rows `tied` (__k, __tie, size) of all keys that
    splitters fall into.

    The keys are few, one splitter each at least; their rows are one line, key after key, in which splitters are found
    by the same counting."""
    order = {k: i for i, k in enumerate(sorted({c.key for c in cuts if isinstance(c, Inside)}))}
    place = F.lit(0).cast("long")
    for k, i in order.items():
        place = F.when(F.col("__k") == k, F.lit(i).cast("long")).otherwise(place)
    line = cut(tied.select(F.shiftleft(place, TIE_BITS).bitwiseOR(F.col("__tie")).alias("k"), "size"))
    sizes = {r[0]: r[1] for r in line.groupBy(F.shiftright("k", TIE_BITS)).agg(F.sum("size")).collect()}
    before, total = {}, 0
    for k, i in order.items():
        before[k], total = total, total + sizes[i]
    inside = [c for c in cuts if isinstance(c, Inside)]
    got = iter(find_splitters(line, 1, slack / total, [before[c.key] + c.bytes for c in inside]))
    pairs = []
    for c in cuts:
        if isinstance(c, Inside):
            at = next(got)
            at = at.key if isinstance(at, Inside) else at  # two rows of one number: either side is within a row
            own = order[c.key]
            pairs.append((c.key, min(max(at - (own << TIE_BITS), 0), (1 << TIE_BITS))))
        else:
            pairs.append((c, 0))
    return pairs


def count_passed(bounds: list[tuple[int, int]], tied: bool = False) -> Column:
    """How many of the ascending `bounds` are at or below the row's key, or its key and number if rows are `tied`."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(_literals(bounds), lambda b: _passed(b, tied)))


def _literals(bounds: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for k, t in bounds])


def _passed(bound: Column, tied: bool) -> Column:
    if tied:
        return (bound["k"] < F.col("__k")) | (bound["k"] == F.col("__k")) & (bound["t"] <= F.col("__tie"))
    return bound["k"] <= F.col("__k")


def shard_rows(df: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", pieces: int | None = None, tolerance: float = 0.001) -> DataFrame:
    """All rows of `df` with size, shard (0 to shards-1) and slot (0, 1, ... within its shard).

    Law `bytes`: the shards' sums of size (UTF-8 bytes of the text plus 8) are near equal, as
    find_splitters() says. Each shard is cut into `pieces` by further splitters (as many as PIECE_BYTES and
    MOST_PIECES ask for, if not given), so that slots are numbered by many tasks: a row's slot is the count of rows in its shard's earlier pieces plus its place in its
    piece, by key and then doc_id. A null text has size 8 and is a text of its own; a null doc_id is hashed
    like a value. Rows that agree in both text and doc_id have one key; where they are too many for one place, random
    numbers, written out with them, tell which goes where, so that for them alone reruns may differ in other columns.
    An empty table gives an empty result. Input columns named size, shard or slot are replaced.
    """
    sized = df.withColumns({"size": utf8_bytes(text) + 8, "__k": sort_key(text, key)})
    keys = cut(sized.select(F.col("__k"), "size"))
    if pieces is None:
        total = keys.agg(F.sum("size")).first()[0] or 0
        pieces = max(1, min(-(-total // (shards * PIECE_BYTES)), MOST_PIECES // shards))
    cuts = find_splitters(keys.withColumnRenamed("__k", "k"), shards * pieces, tolerance)
    split = sorted({c.key for c in cuts if isinstance(c, Inside)})
    if split:
        tied = cut(sized.filter(F.col("__k").isin(split)).withColumn("__tie", F.floor(F.rand() * (1 << TIE_BITS)).cast("long")))
        slack = tolerance * (keys.agg(F.sum("size")).first()[0] or 0) / (shards * pieces)
        bounds = find_ties(tied, cuts, slack)
    else:
        bounds = [(c, 0) for c in cuts]
    outer = bounds[pieces - 1 :: pieces]
    inner = [bounds[s * pieces : (s + 1) * pieces - 1] for s in range(shards)]
    within = F.array(*[_literals(own) for own in inner]) if pieces > 1 else None

    def dealt(x: DataFrame, own: bool = False) -> DataFrame:
        placed = x.withColumn("shard", count_passed(outer, own).cast("int"))
        return placed.withColumn("__piece", F.size(F.filter(F.get(within, F.col("shard")), lambda b: _passed(b, own))) if pieces > 1 else F.lit(0))

    sides = [(keys, sized, False)]
    if split:
        rest = ~F.col("__k").isin(split)
        sides = [(keys.filter(rest), sized.filter(rest), False), (tied, tied, True)]
    counts: dict[tuple[int, int], int] = {}
    for slim, _, own in sides:
        for s, p, n in dealt(slim, own).groupBy("shard", "__piece").count().collect():
            counts[s, p] = counts.get((s, p), 0) + n
    starts = F.array(*[F.array(*[F.lit(sum(counts.get((s, q), 0) for q in range(p))).cast("long") for p in range(pieces)]) for s in range(shards)])
    place = F.row_number().over(Window.partitionBy("shard", "__piece").orderBy("__k", key))
    slot = F.get(F.get(starts, F.col("shard")), F.col("__piece")) + place - 1
    every = [dealt(whole, own).drop("__tie") for _, whole, own in sides]
    made = every[0] if len(every) == 1 else every[0].unionByName(every[1])
    return made.withColumn("slot", slot.cast("long")).drop("__k", "__piece")
