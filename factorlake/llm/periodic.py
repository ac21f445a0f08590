"""Periodic run detection: where a text repeats a stretch of words three times and more, back to back.

A run is found by a suffix automaton of the words. Its suffix links form a tree, in which the states of a prefix's
suffixes are the path from the prefix's state to the root. Word by word that path is accessed as in a link-cut tree: it
becomes one preferred path (a splay tree ordered by depth) whose colour is the word's place. What the access passes on
the way are segments of older colours: the deepest state of a segment of colour p is the longest suffix that ended at p
last, so places p and i agree on just that many words, and when these are at least i - p the text repeats with period
i - p from there to i. That repetition can't be extended to the left; the last i at which it is met ends the run.

The automaton takes plain Python, so only windows that can hold a run pass through it: in a run of period q every
eight-word gram after the first q words occurred at most q words before, hence long stretches of such grams, padded by
the period, hold all runs with both neighbours. Windows are found with numpy over all texts of a batch, by powers of
two of the period; none is dropped and none is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
GRAM = 8


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths of the longest strings, and each prefix's state, of the suffix automaton of `words`."""
    step: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], []
    last = 0
    for w in words:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at >= 0:
            to = step[at][w]
            if length[to] != length[at] + 1:
                copy = len(step)
                step.append(step[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = copy
                while at >= 0 and step[at].get(w) == to:
                    step[at][w] = copy
                    at = link[at]
                to = copy
            link[new] = to
        ends.append(new)
        last = new
    return link, length, ends


class Paths:
    """Preferred paths of a tree with a colour each, as splay trees ordered by depth: the accesses of a link-cut tree."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.left, self.right = list(parent), [-1] * n, [-1] * n
        self.colour = [-1] * n  # of a whole splay tree, at its root

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            g = up[p]
            top = p
            if g >= 0 and (left[g] == p or right[g] == p):
                top = g
                self.lift(p if (left[g] == p) == (left[p] == x) else x)
            self.lift(x)
        if top != x:
            self.colour[x] = self.colour[top]

    def lift(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            moved = left[p] = right[x]
            right[x] = p
        else:
            moved = right[p] = left[x]
            left[x] = p
        if moved >= 0:
            up[moved] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from `x` up to the root's child one colour; what it had: (deepest node, colour) of each
        segment, deepest first. Nodes never reached have colour -1."""
        up, right, old = self.up, self.right, self.colour
        passed, below = [], -1
        while x > 0:
            self.splay(x)
            passed.append((x, old[x]))
            rest = right[x]
            if rest >= 0:
                old[rest] = old[x]
            right[x] = below
            below = x
            x = up[x]
        old[below] = colour
        return passed


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and then period."""
    link, length, ends = automaton(words)
    paths = Paths(link)
    last: dict[tuple[int, int], int] = {}
    for i, state in enumerate(ends):
        for deepest, p in paths.access(state, i):
            period = i - p
            if p >= 0 and length[deepest] >= (LEAST_PERIODS - 1) * period:
                last[p - length[deepest] + 1, period] = i
    found = [(start, end - start + 1, period) for (start, period), end in last.items()]
    return sorted(r for r in found if r[1] >= LEAST_WORDS)


def repeats(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place with a whole gram in its text: how far back in the same text the gram was last (by a 64-bit hash,
    so never further back than it truly was). A huge number where there is none."""
    n = len(ids)
    far = np.full(n, 1 << 60, np.int64)
    if n < GRAM:
        return far
    with np.errstate(over="ignore"):
        key = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
            key ^= key >> np.uint64(29)
        key = key * np.uint64(0xD6E8FEB86659FD93) + owner[: len(key)].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    places = np.flatnonzero(owner[: len(key)] == owner[GRAM - 1 :])
    order = places[np.argsort(key[places], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    return far


def windows(back: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches [a, b) of flat words, each within a text, that hold all runs with both neighbours.

    `back`: repeats(); `bounds`: where texts begin, and the end."""
    found = []
    longest = int(np.diff(bounds).max(initial=0))
    most = 1
    while most // 2 + 1 <= longest // LEAST_PERIODS:
        periods = range(most // 2 + 1, min(most, LEAST_WORDS) + 1) if most <= LEAST_WORDS else [most // 2 + 1]
        least = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in periods) - GRAM + 1
        ends = np.concatenate(([-1], np.flatnonzero(back > most), [len(back)]))
        wide = np.flatnonzero(np.diff(ends) - 1 >= least)
        a, b = ends[wide] + 1, ends[wide + 1]  # grams a to b - 1, all of one text
        text = np.searchsorted(bounds, a, "right") - 1
        found.append(np.stack([np.maximum(a - most - 1, bounds[text]), np.minimum(b + GRAM, bounds[text + 1])], 1))
        most *= 2
    if not found:
        return []
    every = np.concatenate(found)
    every = every[np.argsort(every[:, 0], kind="stable")]
    out: list[tuple[int, int]] = []
    for a, b in every.tolist():
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    solid = np.ascontiguousarray(data[~batches.SPACE[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
    """Texts of the given words, joined by one space."""
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    lengths = ends - starts + ~last
    made = np.append(data, np.uint8(32))[batches.ragged(lengths, starts)]
    made[(np.cumsum(lengths) - 1)[~last]] = 32
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, lengths, texts)))).astype(np.int32)
    return pa.StringArray.from_buffers(texts, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(made)))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def scan(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Counts of words, runs and collapsed texts."""
    data, offsets = batches.flat(texts)
    starts, ends = batches.words(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    bounds = np.searchsorted(starts, offsets, "left")
    ids = word_numbers(data, starts, ends)
    keep = np.ones(len(ids), bool)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for a, b in windows(repeats(ids, owner), bounds):
        text = owner[a]
        for start, length, period in runs_of(ids[a:b].tolist()):
            found[text].append((int(start + a - bounds[text]), length, period))
            keep[a + start + period : a + start + length] = False
    rows = [r for own in found for r in own]
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    ends_of = np.concatenate(([0], np.cumsum([len(own) for own in found]))).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends_of), pa.StructArray.from_arrays(columns, fields=list(RUN)))
    return np.diff(bounds), runs, joined(data, starts[keep], ends[keep], owner[keep], len(texts))


def find_runs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row of `df`, over whole texts.

    Words are runs of anything but ASCII white space, numbered from 0. `runs`: array of (start, length, period), by
    start and then period, of all maximal stretches with smallest period `period`, of at least three periods and 24
    words. `collapsed`: the words joined by one space, without those that any run holds after its first period.
    Null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text. Rows that
    repeat are scanned each; a null key stays; an empty table gives an empty result; other columns are not read.
    A row's work is its own words' times the logarithm of their number; no row waits for another.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches.runs(whole, 1):
                words, runs, collapsed = scan(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), runs, collapsed], names=["key", "n_words", "runs", "collapsed"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
