"""Quality scores by a byte-level convolutional network in numpy.

Every byte has a learned vector. A filter looks at 8 bytes in a row, every 4 bytes, and its responses above 0 are
averaged over chunks of 256 bytes that overlap by half and cover the whole text. A second layer looks at a chunk's
averages; the largest response of each of its units over all chunks is kept, and the kept ones are combined into
one probability. Only bytes are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches

#: Bytes between a filter's places (it looks at twice as many), bytes between chunks (they are twice as long).
STEP, STRIDE = 4, 128
EMBED, FILTERS, UNITS = 8, 32, 64
PLACES = STRIDE // STEP
#: The bounds of the training sample: labelled rows of each class, and the pieces that a longer text is seen by:
#: so many, evenly spaced over the whole text, of so many characters.
SAMPLE_ROWS, PIECES, PIECE = 1500, 64, 1024
STEPS, BATCH, RATE, SEED = 600, 32, 0.005, 11
THRESHOLD = 0.7


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # 2 x STEP * EMBED x FILTERS: what a filter sees first, and after it
    bias: np.ndarray
    units: np.ndarray  # FILTERS x UNITS
    unit_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        none = lambda n: np.zeros(n, np.float32)
        return Network(draw(256, EMBED, s=1.0), draw(2, STEP * EMBED, FILTERS, s=0.125), none(FILTERS), draw(FILTERS, UNITS, s=0.7), none(UNITS), draw(UNITS, s=0.2), none(1))

    def parts(self) -> tuple[np.ndarray, ...]:
        return tuple(getattr(self, name) for name in self.__dataclass_fields__)


@dataclass
class Layout:
    """Texts one after another in strides of STRIDE bytes, zeros after a text's end; a text of n bytes has
    max(1, ceil((n - STRIDE) / STRIDE)) chunks, each of two strides."""

    padded: np.ndarray
    last: np.ndarray  # each text's last place: nothing but zeros follows it
    chunks: np.ndarray  # the first stride of every chunk
    first: np.ndarray  # each text's first chunk

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Layout:
        lengths = np.diff(offsets)
        count = np.maximum(1, -(-(lengths - STRIDE) // STRIDE))
        start = np.cumsum(count + 1) - (count + 1)
        padded = np.zeros(int((count + 1).sum()) * STRIDE, np.uint8)
        padded[batches.ragged(lengths, start * STRIDE)] = data
        return Layout(padded, (start + count + 1) * PLACES - 1, batches.ragged(count, start), np.cumsum(count) - count)


def convolve(net: Network, at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """What filters see from each place on (its own STEP bytes), and their responses there."""
    seen = net.embed[at.padded].reshape(-1, STEP * EMBED)
    after = np.vstack((seen[1:] @ net.filters[1], np.zeros((1, FILTERS), np.float32)))
    after[at.last] = np.tile(net.embed[0], STEP) @ net.filters[1]
    made = seen @ net.filters[0]
    made += after
    made += net.bias
    return seen, np.maximum(made, 0, out=made)


def pool(net: Network, at: Layout, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's mean responses, and what the second layer makes of them."""
    strides = made.reshape(-1, PLACES, FILTERS).sum(axis=1)
    mean = (strides[at.chunks] + strides[at.chunks + 1]) / (2 * PLACES)
    return mean, np.maximum(mean @ net.units + net.unit_bias, 0)


def probability(net: Network, top: np.ndarray) -> np.ndarray:
    logit = (top.astype(np.float64) * net.out).sum(axis=1) + float(net.out_bias[0])
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def score_flat(net: Network, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """A probability for each text. Texts go through in runs of about `most` bytes, a longer text in overlapping
    windows of whole chunks, so memory is bounded for texts of any length."""
    lengths = np.diff(offsets)
    top = np.zeros((len(lengths), UNITS), np.float32)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        if b == a + 1 and lengths[a] > most:
            for begin in range(0, int(lengths[a]) - STRIDE, most):  # a window ends with bytes that its last chunk and filters still see
                own = data[offsets[a] + begin : min(offsets[a + 1], offsets[a] + begin + most + STRIDE + STEP)]
                at = Layout.of(own, np.array([0, len(own)]))
                whole = at.chunks < most // STRIDE if begin + most < lengths[a] else at.chunks >= 0
                top[a] = np.maximum(top[a], pool(net, at, convolve(net, at)[1])[1][whole].max(axis=0))
        else:
            at = Layout.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            top[a:b] = np.maximum.reduceat(pool(net, at, convolve(net, at)[1])[1], at.first)
        a = b
    return probability(net, top)


def gradients(net: Network, at: Layout, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the weighted logistic loss, in the order of the network's parts. Only the chunks whose response is a
    text's largest in some unit are looked at on the way back."""
    seen, made = convolve(net, at)
    mean, high = pool(net, at, made)
    best = np.stack([s + high[s:e].argmax(axis=0) for s, e in zip(at.first, [*at.first[1:], len(high)], strict=True)])
    top = high[best, np.arange(UNITS)]
    off = ((probability(net, top) - labels) * weights / len(labels)).astype(np.float32)
    d_high = np.zeros_like(high)
    np.add.at(d_high, (best, np.arange(UNITS)[None, :]), off[:, None] * net.out * (top > 0))
    used = np.flatnonzero(d_high.any(axis=1))
    d_mean = d_high[used] @ net.units.T / (2 * PLACES)
    d_stride = np.zeros((len(made) // PLACES, FILTERS), np.float32)
    np.add.at(d_stride, at.chunks[used], d_mean)
    np.add.at(d_stride, at.chunks[used] + 1, d_mean)
    hot = np.flatnonzero(d_stride.any(axis=1))
    places = (hot[:, None] * PLACES + np.arange(PLACES)).ravel()
    d_made = np.repeat(d_stride[hot], PLACES, axis=0) * (made[places] > 0)
    raw = at.padded.reshape(-1, STEP)
    following = np.minimum(places + 1, len(seen) - 1)
    ended = np.isin(places, at.last)
    after, raw_after = seen[following].copy(), raw[following].copy()
    after[ended], raw_after[ended] = np.tile(net.embed[0], STEP), 0
    values = np.concatenate((raw[places].ravel(), raw_after.ravel()))
    d_seen = np.concatenate(((d_made @ net.filters[0].T).reshape(-1, EMBED), (d_made @ net.filters[1].T).reshape(-1, EMBED)))
    d_embed = np.stack([np.bincount(values, weights=d_seen[:, k], minlength=256) for k in range(EMBED)], axis=1)
    d_filters = np.stack((seen[places].T @ d_made, after.T @ d_made))
    return d_embed, d_filters, d_made.sum(axis=0), mean[used].T @ d_high[used], d_high.sum(axis=0), off @ top, np.array([off.sum()])


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED, share: tuple[float, float] | None = None) -> Network:
    """`steps` steps of gradient descent (Adam) on the logistic loss. `share` is how often each class comes in the data
    that the texts are a sample of; if not given, as often as among the texts. One class alone is learned as it is."""
    net = Network.start(seed)
    if len(texts) == 0:
        return net
    rng = np.random.default_rng(seed)
    seen = np.bincount(labels, minlength=2)
    want = np.array(seen if share is None else share, float)
    weights = (want / np.maximum(seen, 1))[labels]
    weights /= weights.mean()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate((order, rng.permutation(len(texts))))
        own, order = order[:BATCH], order[BATCH:]
        at = Layout.of(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), np.concatenate(([0], np.cumsum([len(texts[i]) for i in own]))))
        rate = RATE * (1 - step / steps) + 1e-4
        for p, g, (m, v) in zip(net.parts(), gradients(net, at, labels[own], weights[own]), moments, strict=True):
            g = g.astype(np.float32) + 1e-4 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the doc_id as text, modulo 4, is 2. A null id is empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def known_labels(labels: DataFrame, target: str = "quality", key: str = "doc_id") -> DataFrame:
    """(key, label) of rows that may be learned from: label 0 or 1, not held out, a key with one label only."""
    rows = labels.filter(F.col(target).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min(target).alias("label"), F.max(target).alias("other")).filter("label = other").drop("other")


def sample_of(docs: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(__key, label, text) of at most `rows` labelled rows of each class, none held out, by a hash of their keys.

    The keys are chosen from the labels alone, and with them, a bounded table, the texts are fetched. A text of more
    than PIECES * PIECE characters is seen by PIECES pieces, evenly spaced from its first to its last character.
    """
    known = known_labels(labels, target, key)
    by = F.xxhash64(F.col("__key").cast("string"))
    chosen = [known.filter(F.col("label") == c).orderBy(by, "__key").limit(rows) for c in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    found = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    found = found.join(picked, found["__id"] == picked["__key"]).groupBy("__key", "label").agg(F.min("text").alias("text"))
    spare = F.char_length("text") - PIECE
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(F.col("text"), F.floor(i * spare / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)))
    return found.withColumn("text", F.when(spare + PIECE > PIECES * PIECE, F.array_join(pieces, "")).otherwise(F.col("text")))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", **options) -> Network:
    """A network trained on the driver on sample_of(): at most 2 * SAMPLE_ROWS texts of PIECES * PIECE characters.

    Classes weigh as often as they come in all labels. Without labelled rows the network is as it started; with one
    class only, it learns that class."""
    got = sorted((r["__key"], r["label"], r["text"]) for r in sample_of(docs, labels, target, key, **options).collect())
    often = {r["label"]: r["count"] for r in known_labels(labels, target, key).groupBy("label").count().collect()}
    return train([t.encode() for _, _, t in got], np.array([c for _, c, _ in got], np.int64), share=(often.get(0, 0), often.get(1, 0)))


def score(df: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (all, if not given) with the score as column `name`, over whole texts.

    Null and empty texts are scored alike, as one chunk of zero bytes. An empty table gives an empty result.
    An input column of that name is replaced, all others stay.
    """
    held = df.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    names = [f"c{i}" for i in range(len(keep))]
    own = text in keep and df.schema[text].dataType.simpleString() == "string"
    at = keep.index(text) if own else len(keep)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches.runs(whole, at, batches.RUN_BYTES // 2):
                made = score_flat(held.value, *batches.flat(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made)], names=[*names, "score"])

    slim = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *[] if own else [F.col(text).cast("string").alias("text")])
    schema = ", ".join([*[f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)], "score double"])
    return slim.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("score").alias(name))
