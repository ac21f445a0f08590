"""Token counts by a linear longest-match automaton.

A word, with a space before it, is split greedily into the longest entries of the vocabulary; only the
number of pieces is wanted. The vocabulary's trie gets failure links: where a node has no child for a byte,
the pieces that its string is sure to begin with are popped, and matching goes on at the node for what is
left. Node by node in order of depth, these links and popped counts are folded into one table, so each byte
of a text is read once and no piece is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .vocabulary import Vocabulary

NODE_BITS = 20
NODE = (1 << NODE_BITS) - 1


class Automaton:
    """step[node * 256 + byte] is the next node plus 2**20 times the pieces popped; rest[node] is how many
    pieces the node's own string makes. Every single byte has to be an entry."""

    def __init__(self, entries: list[bytes]):
        children: list[dict[int, int]] = [{}]
        parent, byte, depth, entry = [0], [0], [0], [False]
        for token in entries:
            node = 0
            for b in token:
                new = children[node].get(b)
                if new is None:
                    new = len(children)
                    children[node][b] = new
                    children.append({})
                    parent.append(node)
                    byte.append(b)
                    depth.append(depth[node] + 1)
                    entry.append(False)
                node = new
            entry[node] = node > 0
        if len(children) > NODE or len(children[0]) < 256 or not all(entry[n] for n in children[0].values()):
            raise ValueError("the vocabulary needs all single bytes and at most 2**20 nodes")
        self.step = np.zeros((len(children), 256), np.int32)
        self.rest = np.zeros(len(children), np.int32)
        parents, labels, levels, ends = np.array(parent), np.array(byte), np.array(depth), np.array(entry)
        left = np.zeros(len(children), np.int64)  # where matching goes on
        popped = np.zeros(len(children), np.int64)
        for b, n in children[0].items():
            self.step[0, b] = n
        for d in range(1, int(levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(levels == d)
            up = parents[nodes]
            via = self.step[left[up], labels[nodes]].astype(np.int64)
            left[nodes] = np.where(ends[nodes], 0, via & NODE)
            popped[nodes] = np.where(ends[nodes], 1, popped[up] + (via >> NODE_BITS))
            self.step[nodes] = self.step[left[nodes]] + (popped[nodes] << NODE_BITS)[:, None].astype(np.int32)
            for n in nodes.tolist():
                for b, child in children[n].items():
                    self.step[n, b] = child
            self.rest[nodes] = popped[nodes] + self.rest[left[nodes]]
        self.step = self.step.ravel()

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: int | None = 32) -> np.ndarray:
        """How many pieces each word of `data` makes, with the byte `before` put before it. All words go
        forward together, byte by byte; they are sorted by length, so that the running ones come first."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order], lengths[order]
        state = np.full(len(order), 0 if before is None else self.step[before], np.int64)
        count = state >> NODE_BITS
        state &= NODE
        n, k = len(order), 0
        while n and (n := int(np.searchsorted(-lengths[:n], -k, "left"))):
            moved = self.step[state[:n] * 256 + data[at[:n] + k]]
            state[:n] = moved & NODE
            count[:n] += moved >> NODE_BITS
            k += 1
        out = np.empty(len(order), np.int64)
        out[order] = count + self.rest[state]
        return out


_built: dict[int, Automaton] = {}


def automaton_of(key: int, held) -> Automaton:
    """The automaton of a broadcast vocabulary, built once in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(held.value)
    return _built[key]


def word_runs(data: np.ndarray, offsets: np.ndarray, most: int = batches.RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, text) of words, in runs of about `most` bytes; no word is cut."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + most)
        if b < n:
            space = np.flatnonzero(batches.SPACE[data[a:b]])
            if len(space):
                b = a + int(space[-1]) + 1
            else:
                while b < n and not batches.SPACE[data[b : b + most]].any():
                    b = min(n, b + most)
                if b < n:
                    b += int(np.argmax(batches.SPACE[data[b : b + most]])) + 1
        inside = offsets[(offsets >= a) & (offsets <= b)] - a
        starts, ends = batches.words(data[a:b], inside)
        yield starts + a, ends + a, np.searchsorted(offsets, starts + a, "right") - 1
        a = b


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_words, n_tokens) of every row of `df`, over whole texts.

    Words are runs of anything but ASCII white space. Null and empty texts, and texts of white space, have no
    words and no tokens. Rows that repeat are counted each; an empty table gives an empty result.
    """
    vocabulary = Vocabulary.read(path)
    special = set(vocabulary.special.values())
    held = df.sparkSession.sparkContext.broadcast([t for i, t in enumerate(vocabulary.tokens) if i not in special])
    number = hash(path or "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton_of(number, held)
        for whole in rows:
            for batch in batches.runs(whole, 1):
                data, offsets = batches.flat(batch.column(1))
                n_words, n_tokens = np.zeros(len(batch.column(1)), np.int64), np.zeros(len(batch.column(1)), np.int64)
                for starts, ends, owner in word_runs(data, offsets):
                    n_words += np.bincount(owner, minlength=len(n_words))
                    n_tokens += np.bincount(owner, made.pieces(data, starts, ends), len(n_words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n_words), pa.array(n_tokens)], names=["key", "n_bytes", "n_words", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_words long, n_tokens long")
