"""Words, word shingles and MinHash signatures of texts, in numpy over whole batches.

Words are the runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return.  A text of fewer words than the shingle length
has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from tessera.llm.worker import claim

#: Texts are worked on in groups of about so many bytes.
GROUP_BYTES = 2_000_000
_SEEDS = np.random.Generator(np.random.PCG64(20_240_501))
_PLACE = _SEEDS.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    claim("shingles", int)  # holds nothing itself
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``n`` words (all words if fewer)."""
    k = min(n, len(hashes))
    count = len(hashes) - k + 1 if k else 0
    total = np.zeros(count, np.uint64)
    for i in range(k):
        total += hashes[i:i + count] * _PLACE[i]
    return mix(total + np.uint64(k))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(windows(hash_words(text.split()), n))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """``shingle_set`` of many short texts."""
    split = [t.split() for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    if not size.any():
        return [np.empty(0, np.uint64)] * len(texts)
    flat = windows(hash_words([w for words in split for w in words]), n)
    count = np.where(size < n, 0, size - n + 1)
    first = np.repeat(np.cumsum(size) - size, count)
    owner = np.repeat(np.arange(len(texts)), count)
    flat = flat[first + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] if len(owner) else flat[:0]
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])][:len(flat)]
    out = np.split(flat[new], np.searchsorted(owner[new], np.arange(1, len(texts))))
    for k in np.flatnonzero((size > 0) & (size < n)).tolist():
        out[k] = windows(hash_words(split[k]), n)
    return out


class MinHash:
    """``k`` 32-bit min-hashes of many shingle lists at once."""

    def __init__(self, k: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.xor = rng.integers(0, 2**32, k, dtype=np.uint32)
        self.mul = rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of signatures for consecutive lists of the given sizes (all above 0)."""
        start = np.cumsum(size) - size
        x = (flat >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(size), len(self.mul)), np.uint32)
        if len(size):
            for j, (a, m) in enumerate(zip(self.xor, self.mul)):
                out[:, j] = np.minimum.reduceat((x ^ a) * m, start)
        return out


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[slice]:
    """Slices of about ``limit`` bytes of text each."""
    start = size = 0
    for n, t in enumerate(texts):
        if n > start and size + len(t) > limit:
            yield slice(start, n)
            start, size = n, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
