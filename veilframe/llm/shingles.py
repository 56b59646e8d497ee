"""Hashed word shingles of whole texts, vectorised over many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; longer texts are cut at white space.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
LOWER += np.uint64(1)
LOWER[SPACE] = 0
#: Bytes of a word from which on it has a digest for a hash.
LONG = 64
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
STEP = 0xBF58476D1CE4E5B9


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    def __init__(self):
        self.tables = [powers(b, LONG) for b in BASES]

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and where in data it begins."""
        raw = np.frombuffer(data, np.uint8)
        gap = SPACE[raw]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if not len(first):
            return np.empty(0, np.uint64), first
        begin = np.repeat(first, np.diff(np.append(first, len(raw))))
        at = np.arange(first[0], len(raw)) - begin
        codes = LOWER[raw[first[0] :]]
        size = np.add.reduceat(~gap[first[0] :], first - first[0], dtype=np.int64)
        # Longer words get a digest: sums of powers can be made to collide by words of thousands of characters.
        long = np.flatnonzero(size > LONG)
        at = np.minimum(at, LONG - 1)
        out = []
        for i in range(len(BASES)):
            out.append(np.add.reduceat(codes * self.tables[i][at], first - first[0]))
        hashes = mix(out[0] ^ mix(out[1]))
        for k in long.tolist():
            word = data[first[k] : first[k] + size[k]].translate(LOWER_BYTES)
            hashes[k] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)[0]
        return hashes, first

    def documents(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The word hashes of each text."""
        raws = [t.encode("utf-8", "replace") for t in texts]
        i = 0
        while i < len(raws):
            if len(raws[i]) > BLOCK:
                yield self.long(raws[i])
                i += 1
                continue
            j, size = i, 0
            while j < len(raws) and size + len(raws[j]) <= BLOCK:
                size += len(raws[j]) + 1
                j += 1
            words, first = self.words(b"\n".join(raws[i:j]) + b"\n")
            ends = np.cumsum([len(r) + 1 for r in raws[i:j]])
            yield from np.split(words, np.searchsorted(first, ends[:-1]))
            i = j

    def long(self, raw: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + BLOCK)
            while end < len(raw) and not SPACE[raw[end]]:
                end += 1
            out.append(self.words(raw[at:end])[0])
            at = end
        return np.concatenate(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles' hashes in rising order; all words as one if there are fewer than size."""
    if not len(words):
        return np.empty(0, np.int64)
    if len(words) < size:
        whole = np.uint64(len(words))
        for w in words:
            whole = mix(np.array([whole ^ w]) * np.uint64(STEP))[0]
        return np.array([whole]).view(np.int64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out ^ words[k : k + n]) + np.uint64(k + 1)
    return np.unique(out.view(np.int64))
