"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAVE files, resampled to 16-bit PCM.

mu-law and A-law samples expand by tables of 256 entries. ADPCM blocks don't depend on each other, so all
blocks of a run of files are decoded side by side: one numpy step for each sample's place in its block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches

BLOCK = 64
#: Samples that are resampled at once.
WINDOW = 1 << 20

# The IMA ADPCM step sizes and the moves between them.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """Samples of the 256 mu-law codes: bits are inverted; sign, three bits of exponent, four of mantissa."""
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Samples of the 256 A-law codes: even bits are inverted; exponent 0 is linear."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, mantissa * 16 + 8, (mantissa * 16 + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + nibble: the difference, and the next step index * 16."""
    step = np.array(STEPS, np.int32)[:, None]
    nibble = np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + np.array(MOVES, np.int32)[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


MULAW, ALAW = mulaw_table(), alaw_table()
DIFFERENCE, AFTER = adpcm_tables()
CODECS = {"alaw": 6, "mulaw": 7, "adpcm": 17}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples: a block starts with a sample and a step index, then come 120 nibbles."""
    predicted = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    key = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = predicted
    for i, pair in enumerate(codes):
        for half, nibble in enumerate((pair & 15, pair >> 4)):
            key += nibble
            predicted += DIFFERENCE[key]
            np.clip(predicted, -32768, 32767, out=predicted)
            out[1 + 2 * i + half] = predicted
            key = AFTER[key]
    return np.ascontiguousarray(out.T)


def expand(codec: str, payload: np.ndarray) -> np.ndarray:
    """A payload's samples; ADPCM payloads are whole blocks of 64 bytes."""
    if codec == "adpcm":
        return decode_adpcm(payload.reshape(-1, BLOCK)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[payload]


def double_rate(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Twice the rate, in windows: each sample, then the cubic midpoint (-1, 9, 9, -1)/16 to the next one."""
    for a in range(0, len(samples), WINDOW):
        b = min(len(samples), a + WINDOW)
        near = samples[np.clip(np.arange(a - 1, b + 2), 0, len(samples) - 1)].astype(np.int32)
        middle = (9 * (near[1:-2] + near[2:-1]) - near[:-3] - near[3:] + 8) >> 4
        out = np.empty(2 * (b - a), np.int16)
        out[0::2] = samples[a:b]
        out[1::2] = np.clip(middle, -32768, 32767)
        yield out


def wave(payload: bytes, codec: str = "mulaw", rate: int = 8000) -> bytes:
    """A WAVE file of one channel."""
    if codec == "pcm":
        layout = struct.pack("<HHIIHHH", 1, 1, rate, rate * 2, 2, 16, 0)
        samples = len(payload) // 2
    elif codec == "adpcm":
        layout = struct.pack("<HHIIHHHH", 17, 1, rate, rate * BLOCK // 121, BLOCK, 4, 2, 121)
        samples = len(payload) // BLOCK * 121
    else:
        layout = struct.pack("<HHIIHHH", CODECS[codec], 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    head = b"WAVEfmt " + struct.pack("<I", len(layout)) + layout + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def read_wave(media: bytes | memoryview) -> tuple[str, memoryview]:
    """Codec and payload of a WAVE file."""
    view = memoryview(media)
    codec, at = "", 12
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if name == b"fmt ":
            tag = struct.unpack("<H", view[at + 8 : at + 10])[0]
            codec = next((c for c, t in CODECS.items() if t == tag), "pcm")
        elif name == b"data":
            return codec, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in this WAVE file")


def store_audio(df: DataFrame, codec: str = "mulaw", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, with bytes 0 appended up to a positive multiple of 64,
    as the samples of a WAVE file. Null texts are empty; their file holds 64 zero bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches.runs(whole, 1):
                data, offsets = batches.flat(batch.column(1))
                raw = data.tobytes()
                files = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    files.append(wave(raw[a:b].ljust(max(BLOCK, -(-(b - a) // BLOCK) * BLOCK), b"\0"), codec))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")


def loudness(samples: np.ndarray) -> int:
    return int(np.abs(samples.astype(np.int32)).sum(dtype=np.int64) // max(1, len(samples)))


def read_audio(df: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """From (key, n_bytes, media): the payload read back and what it sounds like.

    payload_bytes, payload_sha256 and tail_crc32 (of its last 64 bytes) are the read payload's; media_bytes
    and media_sha256 the stored file's. feature has, for the payload heard as mu-law, A-law and ADPCM, the
    mean size of a sample, and the sign changes and CRC-32 of the PCM resampled from the file's own codec.
    With keep_pcm, pcm is that PCM as a WAVE file of 16 bits at 16 kHz.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches.runs(whole, 2):
                data, offsets = batches.flat(batch.column(2))
                raw = data.data
                out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")}
                read = [read_wave(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                sizes = np.array([len(p) for _, p in read], np.int64)
                blocks = np.concatenate([np.frombuffer(p, np.uint8) for _, p in read]).reshape(-1, BLOCK) if read else np.zeros((0, BLOCK), np.uint8)
                sums = np.empty(len(blocks), np.int64)
                for a in range(0, len(blocks), 1 << 16):
                    sums[a : a + (1 << 16)] = np.abs(decode_adpcm(blocks[a : a + (1 << 16)]).astype(np.int32)).sum(axis=1)
                owned = sizes // BLOCK
                first = np.cumsum(owned) - owned
                adpcm = np.add.reduceat(sums, first) // (owned * 121) if len(sums) else sums
                for i, (codec, payload) in enumerate(read):
                    bytes_ = np.frombuffer(payload, np.uint8)
                    heard = {c: loudness(expand(c, bytes_)) for c in ("mulaw", "alaw")} | {"adpcm": int(adpcm[i])}
                    crc, changes, last, parts = 0, 0, 0, []
                    for part in double_rate(expand(codec, bytes_)):
                        crc = zlib.crc32(part.data, crc)
                        negative = part < 0
                        changes += int(np.count_nonzero(negative[1:] != negative[:-1])) + int(bool(parts or last) and bool(negative[0]) != (last < 0))
                        last = 1 if part[-1] >= 0 else -1
                        if keep_pcm:
                            parts.append(part.tobytes())
                    file = raw[int(offsets[i]) : int(offsets[i + 1])]
                    out["payload_bytes"].append(len(payload))
                    out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(payload[-BLOCK:]))
                    out["media_bytes"].append(len(file))
                    out["media_sha256"].append(hashlib.sha256(file).hexdigest())
                    out["feature"].append(",".join(f"{c}={v}" for c, v in heard.items()) + f",turns={changes},pcm16k={crc:08x}")
                    out["pcm"].append(wave(b"".join(parts), "pcm", 16000) if keep_pcm else None)
                columns = [batch.column(0), batch.column(1)] + [pa.array(v, pa.binary() if k == "pcm" else pa.string() if isinstance(v and v[0], str) else pa.int64()) for k, v in out.items() if k != "pcm" or keep_pcm]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", *[k for k in out if k != "pcm" or keep_pcm]])

    kind = df.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * keep_pcm
    return df.select("key", "n_bytes", "media").mapInArrow(run, schema)
