"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits lie on a ring of eight segments of eight bits. If two differ in at most 2 bits,
then from some segment on every chain of l consecutive segments differs in at most l*2/8 bits: chains of
up to three segments in none, chains of up to seven in at most one. So from that segment on 24 bits are
equal, and of the next four segments the first two or the last two are equal as well. Each of the eight
starts thus gives two keys of 40 bits, and only fingerprints that share a key are compared: first their
chain of seven, then all 64 bits.

keep_similar() keeps one of the texts whose sets of shingles have a Jaccard similarity of at least 0.8. Fingerprints
of such texts often differ in far more than 2 bits, so its candidates share a shingle of their sets' prefixes, which
no such pair can fail to do, and all are confirmed on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEGMENTS, SEGMENT_BITS, MOST_BITS, SEED = 8, 8, 2, 42
#: Fingerprints with a key in common are compared pair by pair up to this many; larger groups are linked
#: through shared neighbours, which loses no link either.
PAIRWISE = 24
#: A fingerprint of so many rows doesn't shuffle them: such fingerprints, few by nature, are broadcast with their
#: component, where they fit BROADCAST_BYTES.
HOT_ROWS = 200
#: What is broadcast, by exact count of rows of 16 bytes: hot fingerprints, and keys of removed rows.
BROADCAST_BYTES = 32 << 20
#: Shingles hashed at once: bounds a task's memory for texts of any length.
CHUNK = 1 << 16
#: Words in a shingle and least Jaccard similarity of near copies.
WORDS, SIMILARITY = 5, 0.8
#: One text in so many, by its hash, has all its shingles counted; one met so often there is common, and at most so
#: many of them are told to the tasks. This only sets the order of shingles; all orders find the same pairs.
SAMPLE, COMMON, MOST_COMMON = 8, 3, 500_000
#: Sets that share a prefix's shingle are compared pair by pair up to this many; of more, with two of them first.
MATES = 4
#: Bits of a set's sketch: the parity of its shingles in so many buckets. Two sketches differ in no more bits than
#: their sets in shingles, so pairs are ruled out by them without a loss.
PARITY = 2048


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of words by XXH64.
    A bit is 1 if it is set in over half of the hashes; a text without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    total = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a : min(n, a + CHUNK)].tolist(), ends[a : a + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    ones = np.flatnonzero(2 * total > n)
    value = sum(1 << int(b) for b in ones)
    return value - (1 << 64) if value >> 63 else value


def add_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, mark, fp long) of every row of `df`: mark is a hash of the text. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, shingle) if t else 0 for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], names=["key", "mark", "fp"])

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, mark long, fp long")


def rotated(fp: Column, start: int) -> Column:
    """The ring read from the segment `start` on."""
    by = start * SEGMENT_BITS
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def chain_keys(fp: Column) -> Column:
    """The sixteen keys of a fingerprint: place (four bits) and 40 bits of its ring."""
    keys = []
    for start in range(SEGMENTS):
        ring = rotated(fp, start)
        head = F.shiftrightunsigned(ring, 40)
        for half, low in enumerate((24, 8)):
            tail = F.shiftrightunsigned(ring, low).bitwiseAND(F.lit(0xFFFF).cast("long"))
            keys.append(F.shiftleft(head, 16).bitwiseOR(tail).bitwiseOR(F.lit((start * 2 + half) << 40).cast("long")))
    return F.array(*keys)


def free_bits(place: int) -> list[int]:
    """The bits of a fingerprint that a key at this place leaves open."""
    start, half = divmod(place, 2)
    ring = [*range(0, 8), *(range(8, 24) if half == 0 else range(24, 40))]
    return [(b - start * SEGMENT_BITS) % 64 for b in ring]


def near_pairs(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that differ in 1 or 2 bits.

    All links between fingerprints of a key's group of up to PAIRWISE are given. In larger groups two
    fingerprints differ in at most 2 bits if and only if one value differs from both in at most 1 (that value
    being one of the two, or between them), so every fingerprint is dealt to the values next to it, and each
    value's fingerprints are linked to the smallest of them: the same fingerprints are connected, without
    making a group's pairs.
    """
    keyed = fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("chain"))
    groups = cut(keyed.groupBy("chain").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    twos = groups.filter("n = 2").select("u", "v", "chain")
    members = cut(keyed.join(groups.filter("n > 2").select("chain", "n"), "chain"))
    small = members.filter(F.col("n") <= PAIRWISE)
    mates = small.select("chain", F.col("fp").alias("u")).join(small.select("chain", F.col("fp").alias("v")), "chain").filter("u < v").select("u", "v", "chain")
    pairs = twos.unionByName(mates)
    differ = F.col("u").bitwiseXOR(F.col("v"))
    start = F.shiftrightunsigned("chain", 41).cast("int")
    chain = reduce(lambda other, s: F.when(start == s, rotated(differ, s)).otherwise(other), range(SEGMENTS), F.lit(0).cast("long"))
    pairs = pairs.filter(F.bit_count(F.shiftrightunsigned(chain, 8)) <= 7 * MOST_BITS // SEGMENTS).filter(F.bit_count(differ) <= MOST_BITS).select("u", "v")
    bits = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long") for b in free_bits(p)]) for p in range(2 * SEGMENTS)])
    large = members.filter(F.col("n") > PAIRWISE)
    hubs = large.select("chain", "fp", F.explode(F.get(bits, F.shiftrightunsigned("chain", 40).cast("int"))).alias("flip")).select("chain", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    least = hubs.groupBy("chain", "hub").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).filter("u < most").drop("most")
    stars = hubs.join(least, ["chain", "hub"]).filter("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of the links (u, v) with the smallest node that it is connected to.

    Large-star and small-star steps in turn: every node's neighbours are hung on their smallest one, until
    nothing changes. The number of rounds grows with the logarithm of the longest path.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small.filter("a <> b"))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """For each row of `df`: key, mark (a hash of its text), fp and component (the smallest key that links reach, its own included).

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any others. Fewer than
    `shingle` words make one shingle. Null keys are never the smallest; a component of null keys alone has a
    null component. Repeated rows are given as often as they come; an empty table gives an empty result.
    """
    rows = cut(add_fingerprints(df, text, key, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    return with_components(rows, fps, near_pairs(fps.select("fp")))


def with_components(rows: DataFrame, fps: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` (key, mark, fp) with their component; `fps` has each fp's least key and number of rows."""
    linked = components(links)
    full = linked.select(F.col("node").alias("fp"), "root").union(linked.select(F.col("root").alias("fp"), "root").distinct())
    least = full.join(fps.select("fp", "least"), "fp").groupBy("root").agg(F.min("least").alias("component"))
    owned = full.join(least, "root").select("fp", "component")
    classes = fps.join(owned, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component"))
    hot = cut(classes.filter(F.col("n") >= HOT_ROWS).drop("n"))
    if hot.count() * 16 > BROADCAST_BYTES:
        return rows.join(classes, "fp").select("key", "mark", "fp", "component")
    others = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(classes.filter(F.col("n") < HOT_ROWS), "fp")
    return others.select("key", "mark", "fp", "component").union(rows.join(F.broadcast(hot), "fp").select("key", "mark", "fp", "component"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """`df` with one row of each component: that of the smallest key, and of the rows that share it that of
    the smallest mark. Rows with a null key, which can't be told from each other, are in no component and all
    stay.

    The rest is removed by key and mark. Where what is removed fits BROADCAST_BYTES (16 bytes a row, by exact
    count) it is broadcast, else the join shuffles.
    """
    return keep_least(df, near_duplicates(df.filter(F.col(key).isNotNull()), text, key, shingle), text, key)


def keep_least(df: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """`df` with one row of each component of `found` (key, mark, component)."""
    found = cut(found.select("key", "mark", "component"))
    kept = found.groupBy("component").agg(F.min(F.struct("key", "mark")).alias("k")).select("k.key", "k.mark")
    gone = cut(found.join(kept, ["key", "mark"], "left_anti").select("key", "mark").distinct())
    few = gone.count() * 16 <= BROADCAST_BYTES
    gone = gone.select(F.col("key").alias("__key"), F.col("mark").alias("__mark"))
    stay = df.withColumn("__hash", F.xxhash64(text))
    stay = stay.join(F.broadcast(gone) if few else gone, (stay[key] == gone["__key"]) & (stay["__hash"] == gone["__mark"]), "left_anti")
    if found.join(kept, ["key", "mark"], "left_semi").groupBy("key", "mark").count().filter("count > 1").limit(1).count():
        named = stay.filter(F.col(key).isNotNull()).dropDuplicates([key, "__hash"])
        stay = named.unionByName(stay.filter(F.col(key).isNull()))
    return stay.drop("__hash")


def shingle_set(text: str, shingle: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the lower-cased words; fewer words make one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, np.int64)
    parts = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.sort(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)).view(np.int64))


def add_sets(df: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(key, mark, hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = pa.array([shingle_set(t or "", shingle) for t in part.column(2).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["key", "mark", "hashes"])

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, mark long, hashes array<long>")


def add_prefixes(df: DataFrame, text: str, key: str, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, mark, fp, n, prefix, sketch) of every row: fp tells equal sets, n is the set's size. Two sets as similar as
    asked share one of the first n - ceil(similarity * n) + 1 shingles in any order; here common ones (sorted, with their
    counts) come last, the most common at the very end."""
    held = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        common, counts = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                fps, sizes, prefixes, sketches = [], [], [], []
                for t in part.column(2).to_pylist():
                    found = shingle_set(t or "", shingle)
                    n = len(found)
                    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
                    times = np.where(common[at] == found, counts[at], 0) if len(common) else np.zeros(n, np.int64)
                    fp = xxh64_intdigest(found.tobytes(), SEED)
                    fps.append(fp - (1 << 64) if fp >> 63 else fp)
                    sizes.append(n)
                    prefixes.append(found[np.argsort(times, kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1])
                    sketches.append(np.packbits((np.bincount(found & (PARITY - 1), minlength=PARITY) & 1).astype(bool)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["key", "mark", "fp", "n", "prefix", "sketch"],
                )

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, mark long, fp long, n int, prefix array<long>, sketch array<long>")


def similar_texts(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, mark, fp, component) of each row of `df`: texts are linked if the Jaccard similarity of their sets of
    shingles is at least `similarity`. Texts without words are equal.

    Sets that share a prefix's shingle are compared pair by pair up to MATES of them. Of larger groups all are
    first compared with two of them, and after that only those in different components, so a group of near copies
    is linked without all its pairs, and no component is cut. Shingles that many texts hold come late in the order of
    all sets, so that sets meet in them only where they are made of little else: of many copies of one text, each changed
    in its own way, those too far apart have too many shingles of their own before the ones they share.
    """
    sample = df.filter(F.pmod(F.xxhash64(text, F.lit(SEED)), F.lit(SAMPLE)) == 0).withColumn("__hash", F.xxhash64(text))
    copied = cut(sample.groupBy("__hash").count().filter("count > 1").select("__hash"))  # copies would count as many texts
    sample = sample.join(F.broadcast(copied) if copied.count() * 8 <= BROADCAST_BYTES else copied, "__hash", "left_anti")
    counts = add_sets(sample, text, key, shingle).select(F.explode("hashes").alias("h")).groupBy("h").count().filter(F.col("count") >= COMMON)
    common = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas().sort_values("h")
    made = cut(add_prefixes(df, text, key, shingle, similarity, (common["h"].to_numpy(np.int64), common["count"].to_numpy(np.int64))))
    rows = made.select("key", "mark", "fp")
    fps = cut(rows.groupBy("fp").agg(F.min("key").alias("least"), F.min(F.struct("key", "mark")).alias("owner"), F.count("*").alias("n")))

    # Of rows of equal sets one is dealt out: the owner, told by key and mark.
    owners = cut(fps.filter("n > 1").select("fp", "owner.key", "owner.mark"))
    few = owners.count() * 24 <= BROADCAST_BYTES
    owned = made.join(F.broadcast(owners) if few else owners, ["fp", "key", "mark"], "left_semi").dropDuplicates(["fp"])
    single = made.join(F.broadcast(owners.select("fp")) if few else owners.select("fp"), "fp", "left_anti")
    slim = [d.select("fp", "n", F.posexplode("prefix").alias("pos", "h")) for d in (single, owned.select("fp", "n", "prefix"))]
    posted = slim[0].unionByName(slim[1]).repartition("h")
    groups = posted.groupBy("h").agg(F.count("*").alias("members")).filter("members > 1")
    posted = cut(posted.join(groups, "h"))
    item = F.struct("fp", "n", "pos")
    share = similarity / (1 + similarity)

    def few_rows(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() * 24 <= BROADCAST_BYTES else rows

    def possible(pairs: DataFrame) -> DataFrame:
        """Of (a, b) those that sizes and places of the shared shingle allow, as (u, v)."""
        size = (F.col("a.n") + F.col("b.n")) * share - 1e-9
        rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
        allowed = pairs.filter("a.fp <> b.fp").filter(rest >= size).filter(F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-9)
        return allowed.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose whole sets are similar; texts of other pairs aren't read again."""
        nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(fps, "fp").select("fp", "owner.key", "owner.mark"))
        sketches = cut(made.join(few_rows(nodes), ["fp", "key", "mark"], "left_semi").select("fp", "n", "sketch").dropDuplicates(["fp"]))
        marked = pairs.join(sketches.select(F.col("fp").alias("u"), F.col("n").alias("m"), F.col("sketch").alias("x")), "u")
        marked = marked.join(sketches.select(F.col("fp").alias("v"), "n", F.col("sketch").alias("y")), "v")
        differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)
        pairs = cut(marked.filter(differ <= (F.col("m") + F.col("n")) * (1 - 2 * share) + 1e-9).select("u", "v"))
        needed = cut(nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp"))
        one = few_rows(needed.select("fp", F.col("key").alias("__key"), F.col("mark").alias("__mark")))
        texts = df.withColumn("__hash", F.xxhash64(text)).join(one, (F.col(key) == F.col("__key")) & (F.col("__hash") == F.col("__mark")), "left_semi")
        if texts.count() > needed.count():  # rows that repeat
            texts = texts.dropDuplicates([key, "__hash"])
        sets = cut(add_sets(texts.select(key, text), text, key, shingle).join(few_rows(needed), ["key", "mark"]).select("fp", "hashes"))
        both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("hashes").alias("x")), "u").join(sets.select(F.col("fp").alias("v"), F.col("hashes").alias("y")), "v")
        same = F.size(F.array_intersect("x", "y"))
        return cut(both.filter(same >= (F.size("x") + F.size("y") - same) * similarity - 1e-9).select("u", "v"))

    small = posted.filter(F.col("members") <= MATES)
    mates = small.select("h", item.alias("a")).join(small.select("h", item.alias("b")), "h").filter("a.fp < b.fp")
    large = posted.filter(F.col("members") > MATES)
    firsts = [large.groupBy("h").agg(F.min_by(item, by).alias("b")) for by in (F.struct("pos", F.xxhash64("fp")), F.xxhash64("fp", F.lit(SEED)))]
    tries = [large.select("h", item.alias("a")).join(first, "h") for first in firsts]
    links = confirmed(cut(reduce(DataFrame.unionByName, [possible(mates), *map(possible, tries)]).distinct()))
    linked = components(links)
    roots = linked.select(F.col("node").alias("fp"), "root").union(linked.select(F.col("root").alias("fp"), "root").distinct())
    placed = cut(large.join(roots, "fp", "left").select("h", item.alias("a"), F.coalesce("root", "fp").alias("root")))
    main = placed.groupBy("h").agg(F.min_by("root", F.struct("a.pos", F.xxhash64("a.fp"))).alias("main"))
    others = placed.join(main, "h").filter("root <> main").select("h", F.col("a").alias("b"), F.col("root").alias("other"))
    rest = cut(possible(placed.join(others, "h").filter("root <> other")))
    if rest.limit(1).count():
        links = links.unionByName(confirmed(rest))
    return with_components(rows, fps, links)


def keep_similar(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`df` with one row of each component of similar_texts, chosen as in keep_one."""
    return keep_least(df, similar_texts(df.filter(F.col(key).isNotNull()), text, key, shingle, similarity), text, key)
