"""Byte-pair encoding, token counts, media columns, near-duplicates and quality scores."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from factorlake.llm import batches, bpe, media, quality, queries, simhash, token_counts
from factorlake.llm.vocabulary import Vocabulary, default_path

from .conftest import TEXTS, rows_of


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(default_path())
    made.no_truncation()
    made.no_padding()
    return made


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab \n'strevlmd0é日", max_size=200))
def test_encoding_is_the_librarys(encoder, library, text):
    ids, ends = encoder.encode([text])
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and ends.tolist() == [0, len(want)]
    assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_verified_pairs_are_exact(encoder):
    rng = random.Random(3)
    ids = [i for i in range(50256)]
    a = np.array(rng.choices(ids, k=4000), np.int32)
    b = np.array(rng.choices(ids, k=4000), np.int32)
    want = [encoder.merge(encoder.bytes[x] + encoder.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert encoder.compatible(a, b).tolist() == want


def test_forgetting_words_changes_nothing(vocabulary, monkeypatch):
    texts = [t or "" for t in TEXTS]
    want = bpe.Encoder(vocabulary).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    small = bpe.Encoder(vocabulary)
    assert [i for t in texts for i in small.encode([t])[0].tolist()] == want


def test_encode_odd_rows(edge, empty, library):
    got = rows_of(bpe.encode(edge, decoded=True))
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in rows_of(edge))
    assert sorted((str(r["key"]), r["ids"], r["decoded"]) for r in got) == want
    assert bpe.encode(empty).count() == 0
    again = rows_of(bpe.decode(bpe.encode(edge)))
    assert sorted(r["decoded"] for r in again) == sorted(w for _, _, w in want)


def greedy(word, entries):
    n = at = 0
    while at < len(word):
        end = len(word)
        while word[at:end] not in entries:
            end -= 1
        at, n = end, n + 1
    return n


def test_token_counts_by_brute_force(edge, empty, vocabulary):
    entries = {t for i, t in enumerate(vocabulary.tokens) if i != 50256}
    want = []
    for r in rows_of(edge):
        words = (r["text"] or "").encode().split()
        want.append((str(r["doc_id"]), len((r["text"] or "").encode()), len(words), sum(greedy(b" " + w, entries) for w in words)))
    got = rows_of(token_counts.count_tokens(edge))
    assert sorted((str(r["key"]), r["n_bytes"], r["n_words"], r["n_tokens"]) for r in got) == sorted(want)
    assert token_counts.count_tokens(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5), max_size=30), st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=10))
def test_automaton_on_any_vocabulary(extra, words):
    entries = list({bytes([b]) for b in range(256)} | set(extra))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    got = token_counts.Automaton(entries).pieces(data, starts, ends, None)
    assert got.tolist() == [greedy(w, set(entries)) for w in words]


def test_words_over_run_borders():
    texts = [b"aa bb", b"", b"c" * 50, b" d  e ", b"ff"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = [(data[s:e].tobytes(), int(o)) for part in token_counts.word_runs(data, offsets, 7) for s, e, o in zip(*part, strict=True)]
    assert got == [(w, i) for i, t in enumerate(texts) for w in t.split()]


def slow_adpcm(block):
    predicted = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [predicted]
    for code in [x for b in block[4:] for x in (b & 15, b >> 4)]:
        step = media.STEPS[index]
        diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        predicted = max(-32768, min(32767, predicted - diff if code & 8 else predicted + diff))
        index = max(0, min(88, index + media.MOVES[code & 7]))
        out.append(predicted)
    return out


def test_codecs():
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (40, 64)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]
    assert (media.MULAW[0], media.MULAW[0x7F], media.MULAW[0x80], media.MULAW[0xFF]) == (-32124, 0, 32124, 0)
    assert (media.ALAW[0x55], media.ALAW[0xD5], media.ALAW[0x2A], media.ALAW[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(media.ALAW.tolist())) == 256 and sorted(media.ALAW) == sorted(-media.ALAW)
    sound = rng.integers(-30000, 30000, 1000).astype(np.int16)
    whole = np.concatenate(list(media.double_rate(sound)))
    assert whole[::2].tolist() == sound.tolist() and len(whole) == 2000


def test_resampling_over_window_borders(monkeypatch):
    sound = np.arange(-500, 500, dtype=np.int16) * 31
    want = np.concatenate(list(media.double_rate(sound))).tolist()
    monkeypatch.setattr(media, "WINDOW", 97)
    assert np.concatenate(list(media.double_rate(sound))).tolist() == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_media_round_trip(edge, empty, codec):
    stored = media.store_audio(edge, codec)
    got = rows_of(media.read_audio(stored))
    assert len(got) == edge.count()
    want = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in rows_of(edge))
    padded = {w: w.ljust(max(64, -(-len(w) // 64) * 64), b"\0") for _, w in want}
    assert sorted((str(r["key"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(
        (k, len(w), len(padded[w]), hashlib.sha256(padded[w]).hexdigest(), zlib.crc32(padded[w][-64:])) for k, w in want
    )
    for r in rows_of(stored):
        assert media.read_wave(bytes(r["media"]))[0] == codec
    for r in got:
        name, pcm = media.read_wave(bytes(r["pcm"]))
        assert name == "pcm" and zlib.crc32(pcm) == int(r["feature"].split("pcm16k=")[1], 16)
        assert len(pcm) == 4 * (r["payload_bytes"] if codec != "adpcm" else r["payload_bytes"] // 64 * 121)
    same = {r["n_bytes"]: r for r in got if r["n_bytes"] == 0}
    assert len({r["feature"] for r in got if r["n_bytes"] == 0}) == len(same) == 1
    assert media.read_audio(media.store_audio(empty)).count() == 0


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest key by component of fingerprints at 2 bits or fewer, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def test_near_duplicates_by_brute_force(spark, sf_dir, edge, empty, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edge.select((edge.doc_id + 100000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    want = sorted((str(k), p - (1 << 64) if p >> 63 else p, str(c)) for (k, p), c in zip(prints, classes(prints), strict=True))
    assert sorted((str(r["key"]), r["fp"], str(r["component"])) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [-1, 32 << 20])
def test_hot_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", limit)
    texts = ["same words here and there"] * 5 + ["other words"] * 3 + ["one more", "one more", None, ""]
    df = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [(10 - i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    want = sorted((k, c) for (k, _), c in zip(prints, classes(prints), strict=True))
    assert sorted((r["key"], r["component"]) for r in simhash.near_duplicates(df).collect()) == want


@pytest.mark.parametrize("pairwise", [2, 24, 10_000])
def test_links_of_crowded_fingerprints(spark, monkeypatch, pairwise):
    """Many fingerprints within a few bits: the same components, whichever way a crowded key is linked."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(4)
    centers = [rng.getrandbits(64) for _ in range(3)]
    made = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(150)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v, v) for v in made]
    frame = spark.createDataFrame([(s,) for s, _ in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.near_pairs(frame)).collect()}
    want = classes(signed)
    assert [got.get(s, s) for s, _ in signed] == want


def test_one_of_each_group_stays(edge, empty):
    kept = rows_of(simhash.keep_one(edge))
    keyed = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows_of(edge) if r["doc_id"] is not None]
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(classes(keyed)))
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert simhash.keep_one(empty).count() == 0


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = rows_of(queries.op8_quality(spark, sf_dir))
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    own = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pairs = [(a > b) for a, x in own for b, y in own if x == 1 and y == 0]
    assert not pairs or sum(pairs) / len(pairs) > 0.8


def test_quality_learns_junk():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "and", "over", "lazy", "quick", "river", "stone"]) for _ in range(rng.randint(5, 400))) for _ in range(120)]
    bad = [g[: len(g) // 2] + " BUY!! NOW!! CHEAP!! DEAL!! " * 4 + g[len(g) // 2 :] for g in good[:60]] + [" ".join(["same"] * 60 + [g[:50]]) for g in good[60:]]
    texts = [t.encode() for t in good + bad]
    y = np.array([1] * 120 + [0] * 120)
    order = np.random.default_rng(0).permutation(240)
    net = quality.train([texts[i] for i in order[:160]], y[order[:160]], steps=300)
    held = [texts[i] for i in order[160:]]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in held])))
    score = quality.score_flat(net, np.frombuffer(b"".join(held), np.uint8), offsets)
    assert ((score >= 0.7) == y[order[160:]]).mean() > 0.95


def test_scores_see_the_whole_text_and_batches_dont_matter(edge, empty):
    net = quality.Network.start()
    rows = rows_of(edge)
    want = {}
    for t in {r["text"] for r in rows}:
        raw = (t or "").encode()
        want[t] = float(quality.score_flat(net, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
    got = rows_of(quality.score(edge, net))
    assert len(got) == len(rows) and set(got[0]) == set(edge.columns)
    assert all(abs(r["score"] - want[r["text"]]) < 1e-5 for r in got)
    long = b"x " * 20000
    changed = long[:-30] + b"!!!!????!!!!????!!!!????!!!!??"
    flat = lambda b: quality.score_flat(net, np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
    assert flat(long) != flat(changed)
    assert quality.score(empty, net).count() == 0


def slow_score(net, text):
    """The network, place by place: filters over 8 bytes every 4, means of chunks of 256 bytes every 128, largest of units."""
    step, stride = quality.STEP, quality.STRIDE
    chunks = max(1, -(-(len(text) - stride) // stride))
    data = text.ljust((chunks + 1) * stride + step, b"\0")
    flat = net.filters.reshape(2 * step * quality.EMBED, quality.FILTERS).astype(float)
    respond = lambda p: np.maximum(np.concatenate([net.embed[b] for b in data[p : p + 2 * step]]).astype(float) @ flat + net.bias, 0)
    top = np.zeros(quality.UNITS)
    for c in range(chunks):
        mean = np.mean([respond(p) for p in range(c * stride, (c + 2) * stride, step)], axis=0)
        top = np.maximum(top, mean @ net.units + net.unit_bias)
    return 1 / (1 + np.exp(-(top @ net.out + net.out_bias[0])))


@pytest.mark.parametrize("most", [1 << 19, 512])
def test_scores_are_the_networks_by_a_slow_loop(most):
    rng = random.Random(5)
    net = quality.Network.start(3)
    net.bias[:] = np.random.default_rng(1).standard_normal(quality.FILTERS) * 0.1
    lengths = [0, 1, 7, 127, 128, 129, 255, 256, 257, 384, 385, 511, 512, 513, 600, 640, 641, 1500, 3000]
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in lengths]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    got = quality.score_flat(net, np.frombuffer(b"".join(texts), np.uint8), offsets, most)
    assert np.abs(got - [slow_score(net, t) for t in texts]).max() < 1e-5


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (5, 300, 700)]
    labels, weights = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    net = quality.Network.start(4)
    for name in net.__dataclass_fields__:
        setattr(net, name, getattr(net, name).astype(np.float64))
    at = quality.Layout.of(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, texts))))))

    def loss():
        high = quality.pool(net, at, quality.convolve(net, at)[1])[1]
        p = quality.probability(net, np.maximum.reduceat(high, at.first))
        return float(-(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / len(labels))

    for part, grad in zip(net.parts(), quality.gradients(net, at, labels, weights), strict=True):
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        before = part[place]
        part[place] = before + 1e-5
        up = loss()
        part[place] = before - 1e-5
        slope = (up - loss()) / 2e-5
        part[place] = before
        assert abs(slope - grad[place]) < 2e-2 * abs(slope) + 1e-5


def test_long_texts_are_sampled_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(quality, "PIECES", 5)
    monkeypatch.setattr(quality, "PIECE", 10)
    text = "".join(chr(97 + i % 26) for i in range(2000)) + "THE END..."
    docs = spark.createDataFrame([(1, text), (5, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    got = {r["__key"]: r["text"] for r in quality.sample_of(docs, labels).collect()}
    if 1 in got:
        assert len(got[1]) == 50 and got[1].startswith(text[:10]) and got[1].endswith("THE END...")
    assert got.get(5, "short") == "short" and got


def test_fit_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.fit(edge, none)
    assert (net.filters == quality.Network.start().filters).all()
    alone = quality.train([b"good text"] * 3, np.array([1, 1, 1]), steps=60)
    assert quality.score_flat(alone, np.frombuffer(b"good text", np.uint8), np.array([0, 9]))[0] > 0.5
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 7), (5, 1)], "doc_id long, quality int")
    got = quality.sample_of(edge, odd).collect()
    assert {r["__key"] for r in got} <= {5}


def test_runs_keep_rows_whole():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 100, "c"])], names=["t"])
    parts = [p.column(0).to_pylist() for p in batches.runs(batch, 0, 12)]
    assert [x for p in parts for x in p] == batch.column(0).to_pylist() and parts[0] == ["a" * 10, None, ""]
    data, offsets = batches.flat(batch.slice(2, 2).column(0))
    assert data.tobytes() == b"b" * 100 and offsets.tolist() == [0, 0, 100]


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_components(rows):
    """Smallest key by row, of rows (key, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def similar_rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d"]
    line = [word() for _ in range(12)]
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(20, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    template = [word() for _ in range(80)]
    for i in range(40):  # a chain's ends differ, its neighbours don't
        template[i * 2] = word()
        texts.append(" ".join(template))
    texts += [" ".join(line + [word() for _ in range(rng.randrange(4))]) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("mates", "common"), [(4, 6), (2, 1), (1000, 6)])
def test_near_copies_by_brute_force(spark, monkeypatch, mates, common):
    monkeypatch.setattr(simhash, "MATES", mates)
    monkeypatch.setattr(simhash, "COMMON", common)
    rows = similar_rows()
    want = plain_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["key"]: r["component"] for r in rows_of(simhash.similar_texts(df))}
    assert got == want
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r["doc_id"] for r in rows_of(kept)) == sorted(set(want.values()))
    few = simhash.keep_one(df).count()
    assert kept.count() < few
    assert corpus_pipeline.drop_near_copies(spark, df.filter("false"), "").count() == 0


def test_many_copies_each_changed_in_its_own_way(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(100), i % 8):
            copy[at] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(copy[: 100 - i % 5]))
    rows = list(enumerate(texts))
    got = rows_of(simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")))
    want = plain_components(rows)
    assert {r["key"]: r["component"] for r in got} == want
    assert 10 < len(set(want.values())) < 140
