"""The public byte-level BPE vocabulary, read on the driver and broadcast (about 1 MB)."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    tokens: list[bytes]  # by id
    merges: list[tuple[int, int, int]]  # (left id, right id, id), by rank
    special: dict[str, int]

    @staticmethod
    def read(path: str | None = None) -> Vocabulary:
        with open(path or default_path(), encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_of_letter()
        special = {t["content"]: t["id"] for t in made.get("added_tokens", []) if t.get("special")}
        ids = made["model"]["vocab"]
        tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in ids.items():
            tokens[i] = text.encode() if text in special else bytes(letters[c] for c in text)
        for text, i in special.items():
            tokens[i] = text.encode()
        merges = []
        for m in made["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((ids[a], ids[b], ids[a + b]))
        return Vocabulary(tokens, merges, special)
