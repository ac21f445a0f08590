"""Byte-pair encoding by speculation and verification, and decoding.

A text is split into words by the vocabulary's pattern. For a word not met before, greedy longest match
proposes tokens. A sequence of tokens is what merging gives if and only if it holds for every adjacent
pair that merging the two tokens' bytes gives back the two tokens; numpy tests all pairs of all new words
at once. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .vocabulary import Vocabulary

# Fixed value: the byte-level vocabulary's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their tokens, in each Python worker; beyond, all are dropped and met anew.
MOST_WORDS = 250_000
#: Longer words are not looked up again.
KEPT_LENGTH = 48
NEVER = np.iinfo(np.int32).max


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most_words: int | None = None):
        import regex

        self.most_words = MOST_WORDS if most_words is None else most_words
        self.find = regex.compile(PATTERN).findall
        self.bytes = vocabulary.tokens
        self.special = vocabulary.special
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        special = set(self.special.values())
        self.ids = {t: i for i, t in enumerate(self.bytes) if t and i not in special}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.longest: dict[int, int] = {}
        for t in self.ids:
            self.longest[t[0]] = max(self.longest.get(t[0], 1), len(t))
        n = len(self.bytes)
        self.rank_of = {(a, b): (r, c) for r, (a, b, c) in enumerate(vocabulary.merges)}
        self.rank = np.full(n, -1, np.int32)
        self.left, self.right = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for r, (a, b, c) in enumerate(vocabulary.merges):
            self.rank[c], self.left[c], self.right[c] = r, a, b
        keys = np.array([a << 20 | b for a, b, _ in vocabulary.merges], np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str | int, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = self.words = 0
        self.starts = np.zeros(1 << 16, np.int64)
        for i in self.special.values():
            self.keep(i, [i])

    def keep(self, word: str | int, tokens: list[int]) -> None:
        if self.used + len(tokens) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(tokens)), np.int32)))
        if self.words + 1 == len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.place[word] = self.words
        self.words += 1
        self.pool[self.used : self.used + len(tokens)] = tokens
        self.used += len(tokens)
        self.starts[self.words] = self.used

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, at, n, get, longest = [], 0, len(word), self.ids.get, self.longest
        while at < n:
            end = min(n, at + longest[word[at]])
            while (token := get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER if there is none."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a pair of tokens gives the pair back.

        Merging is undone from its end: of the last piece of `a` and the first piece of `b` the one made
        later is split. While two pieces stand side by side, the merge across the border must not come before
        both are used up: not before the merge that uses the left one (which comes first on equal rank, being
        further left), nor before or together with the merge that uses the right one.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        p, q = a.copy(), b.copy()
        use_p, use_q = np.full(len(a), NEVER, np.int32), np.full(len(a), NEVER, np.int32)
        while len(live):
            across = self.merge_rank(p, q)
            bad = (across != NEVER) & (across < use_p) & (across <= use_q)
            good[live[bad]] = False
            rank_p, rank_q = self.rank[p], self.rank[q]
            on = ~bad & ((rank_p >= 0) | (rank_q >= 0))
            live, p, q, use_p, use_q, rank_p, rank_q = (x[on] for x in (live, p, q, use_p, use_q, rank_p, rank_q))
            cut_p = rank_p > rank_q
            use_p, use_q = np.where(cut_p, rank_p, use_p), np.where(cut_p, use_q, rank_q)
            p, q = np.where(cut_p, self.right[p], p), np.where(cut_p, q, self.left[q])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals, by a heap over linked places."""
        tokens: list[int] = [self.single[b] for b in word]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, tokens[i], tokens[i + 1], m[1]) for i in range(n - 1) if (m := self.rank_of.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else n
            if j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.rank_of.get((made, tokens[k])):
                    heapq.heappush(heap, (m[0], i, made, tokens[k], m[1]))
            h = before[i]
            if h >= 0 and (m := self.rank_of.get((tokens[h], made))):
                heapq.heappush(heap, (m[0], h, tokens[h], made, m[1]))
        return [t for t in tokens if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Tokens of new words: proposed, verified all at once, merged exactly where a pair fails."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        tokens = np.fromiter((t for p in proposed for t in p), np.int32, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[inner].astype(np.int64) << 20 | tokens[inner + 1], return_inverse=True)
        fine = self.compatible((pairs >> 20).astype(np.int32), (pairs & 0xFFFFF).astype(np.int32))
        failing = np.zeros(len(words), bool)
        failing[owner[inner[~fine[back]]]] = True
        for i, w in enumerate(words):
            self.keep(w, self.merge(raw[i]) if failing[i] else proposed[i])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and their offsets."""
        if self.words > self.most_words:
            self.forget()
        words: list[str | int] = []
        counts = []
        for text in texts:
            before = len(words)
            if self.split and any(s in text for s in self.special):
                for part in self.split(text):
                    words += [self.special[part]] if part in self.special else self.find(part)
            else:
                words += self.find(text)
            counts.append(len(words) - before)
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.learn(new)
        where = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        starts = self.starts[where]
        lengths = self.starts[where + 1] - starts
        ids = self.pool[batches.ragged(lengths, starts)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del self.place[w]
        return ids, ends

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[int, Encoder] = {}


def encoder_of(key: int, shared, most_words: int | None = None) -> Encoder:
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(shared.value, most_words)
    return _made[key]


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", decoded: bool = False, most_words: int | None = None) -> DataFrame:
    """(key, ids) of every row of `df`, over whole texts; with `decoded` also the text that the ids decode to. A Python
    worker keeps up to `most_words` words with their tokens (MOST_WORDS, if not given): fewer take less memory and more time.

    Special tokens in a text are single tokens. A null text is empty and has no ids. Rows that repeat are
    encoded each; an empty table gives an empty result.
    """
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    number = hash((path or "", most_words))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(number, held, most_words)
        for whole in rows:
            for batch in batches.runs(whole, 1, batches.RUN_BYTES // 2):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids, ends = encoder.encode(texts)
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))]
                if decoded:
                    listed = ids.tolist()
                    columns.append(pa.array([encoder.decode(listed[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", *["decoded"] * decoded])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + ", decoded string" * decoded
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", key: str = "key") -> DataFrame:
    """(key, decoded) of rows of token ids; bytes that are no UTF-8 decode to U+FFFD. Null ids decode to ''."""
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    number = hash((path or "", None))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(number, held)
        for batch in rows:
            made = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded string")
