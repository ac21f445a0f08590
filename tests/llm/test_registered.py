"""The registered queries over whole tables against plain versions: ids, digests and counts."""

import hashlib
import re
import zlib

import pytest

from factorlake.llm import media, queries
from factorlake.llm.vocabulary import Vocabulary, default_path

from .conftest import rows_of
from .test_texts import classes, greedy, plain_fingerprint


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op4_is_the_librarys(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for k, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((k, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = rows_of(queries.op4_byte_pairs(spark, sf_dir))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_op5_stores_every_byte(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows_of(queries.op5_telephony_audio(spark, sf_dir))}
    assert len(got) == len(docs)
    by_text = {}
    for k, t in docs:
        raw = t.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        name, pcm = media.read_wave(bytes(r["pcm"]))
        assert name == "pcm" and r["media_bytes"] > len(padded) and zlib.crc32(pcm) == int(r["feature"].split("pcm16k=")[1], 16)
        own = (r["media_sha256"], r["feature"])
        assert by_text.setdefault(t, own) == own


def test_op7_fingerprints_and_components(spark, sf_dir, docs):
    prints = [(k, plain_fingerprint(t)) for k, t in docs]
    want = sorted((k, f"{p:016x}", c) for (k, p), c in zip(prints, classes(prints), strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(queries.op7_simhash(spark, sf_dir))) == want


def test_op10_counts_pieces(spark, sf_dir, docs):
    entries = {t for i, t in enumerate(Vocabulary.read().tokens) if i != 50256}
    want = []
    for k, t in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        want.append((k, len(t.encode()), len(words), sum(greedy(b" " + w, entries) for w in words)))
    got = rows_of(queries.op10_token_counts(spark, sf_dir))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_words"], r["n_tokens"]) for r in got) == sorted(want)
