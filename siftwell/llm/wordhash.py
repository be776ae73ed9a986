"""Hashes of the words of a text, as NumPy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.full(size, _BASE, np.uint64)) * np.uint64(inverse)
            self.down = np.cumprod(np.full(size, inverse, np.uint64)) * np.uint64(_BASE)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _blocks(data: bytes) -> Iterator[bytes]:
    """data in pieces of about BLOCK bytes that end at a space, so that memory does not follow the longest text."""
    at = 0
    while len(data) - at > BLOCK:
        end = data.find(b" ", at + BLOCK)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of data, whose words are separated by the byte 0x20 only, in order, and where it starts and ends."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = b != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts = edge[word[edge]]
    ends = edge[~word[edge]]
    if word[0]:
        starts = np.concatenate(([0], starts))
    if word[-1]:
        ends = np.concatenate((ends, [len(b)]))
    up, down = _POWERS.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), starts, ends


def all_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, in blocks, so that only the result follows the length of data. A word that fills several blocks has hash 0."""
    parts, at = [], 0
    for block in _blocks(data):
        if len(block) > 4 * BLOCK:
            spans = [m.span() for m in re.finditer(rb"[^ ]+", block)]
            hashes = np.array([word_spans(block[a:b])[0][0] if b - a <= BLOCK else 0 for a, b in spans], np.uint64)
            starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        else:
            hashes, starts, ends = word_spans(block)
        parts.append((hashes, starts + at, ends + at))
        at += len(block)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends


def word_hashes(data: bytes) -> np.ndarray:
    """The hashes of word_spans; a long text is hashed in blocks."""
    return np.concatenate([word_spans(block)[0] for block in _blocks(data)])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of fewer words, the whole run is the only one."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i])
    return np.unique(mix64(out + np.uint64(k)))
