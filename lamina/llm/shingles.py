"""Word hashes, sets of word shingles and MinHash, in numpy. All hashes depend on the bytes alone."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x100000001B3)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(1 << 16, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(1 << 16, pow(int(_BASE), -1, 1 << 64), np.uint64))
WIDTH = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each number spread."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if n > len(_POWERS):
        size = 1 << n.bit_length()
        _POWERS = np.cumprod(np.full(size, _BASE, np.uint64))
        _INVERSES = np.cumprod(np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64))
    return _POWERS[:n], _INVERSES[:n]


def run_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    power, inverse = _powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)))
    return mixed((total[end] - total[begin]) * inverse[begin])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each white-space separated word."""
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    return run_hashes(raw, begin, end)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `width` words; a shorter text is one shingle, a text
    without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k : k + n]
    return np.unique(mixed(h))


def set_key(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHash:
    """`size` hash functions of 64 bits, of which the least value's upper 32 bits are kept."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), 2048):
            part = shingles[k : k + 2048]
            out = np.minimum(out, (self.a[:, None] * part + self.b[:, None]).min(axis=1))
        return (out >> np.uint64(32)).astype(np.uint32)
