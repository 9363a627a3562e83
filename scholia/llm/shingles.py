"""Hashed word-shingle sets of whole texts, in numpy, without a Python step per word.

A word's hash is a polynomial over a random 64-bit value for each byte (A-Z share those of a-z), read off
running sums; a shingle's hash mixes its words' hashes in order. Sets are sorted arrays of distinct 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CHUNK = 1 << 19
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _CHUNK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(b)]])
    start, stop = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start]), start


def _words(text: bytes) -> np.ndarray:
    """Of one text of any length, a bounded piece at a time."""
    out, at = [], 0
    while at < len(text):
        stop = at + _CHUNK
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        out.append(word_hashes(text[at:stop])[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        n = len(words)
        if not n:
            return words
    x = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        x = mix(x * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    return mix(x + np.uint64(n))


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer than n words: the whole sequence as one; none: empty."""
    block: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode()
        if len(b) >= _CHUNK:
            yield from _sets(block, n)
            block, size = [], 0
            yield np.unique(_shingles(_words(b), n))
            continue
        block.append(b)
        size += len(b) + 1
        if size >= _CHUNK:
            yield from _sets(block, n)
            block, size = [], 0
    yield from _sets(block, n)


def _sets(block: list[bytes], n: int) -> Iterator[np.ndarray]:
    if not block:
        return
    words, start = word_hashes(b"\n".join(block))
    bounds = np.cumsum([0] + [len(b) + 1 for b in block])
    at = np.searchsorted(start, bounds)
    if len(words) >= n:
        x = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            x = mix(x * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
        x = mix(x + np.uint64(n))
    for a, z in zip(at[:-1], at[1:], strict=True):
        yield np.unique(x[a : z - n + 1]) if z - a >= n else np.unique(_shingles(words[a:z], n))
