"""Hashed word shingles of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        shingles: Iterator[bytes] | list[bytes] = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], "<u8")


class _Words(dict):
    """XXH64 of words, each computed once while it is remembered."""

    MOST = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()
#: Multipliers of the places in a shingle: powers of an odd number; those of the last mixing.
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def rolled_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Other 64-bit hashes of the same shingles, made from those of the words: some times as fast where a word repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return shingle_hashes(text, shingle)
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for i in range(shingle):
        out += own[i : i + n] * np.uint64(pow(_BASE, i + 1, 1 << 64))
    for shift, factor in zip((30, 27), _MIX):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number whose bits are 1 where over half of the hashes have a 1."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])
