"""Hashed word shingles of whole texts, for many texts at a time.

Words are the stretches without ASCII white space of the text with A-Z lowered.
A word is hashed as a polynomial over its bytes (prefix sums over the whole
batch, so no loop runs over words), mixed, and a shingle combines the hashes of
its words in order. Two shingles share a 64-bit hash by accident with a
probability of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
GROUP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int):
        if n > len(self.up):
            size = max(n, GROUP_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of the text that it is in; text i is data[bounds[i]:bounds[i + 1]]."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # at the first byte of a text a word starts, and one before it ends
    first[bounds] = True
    before = np.concatenate([[False], solid])
    starts = np.flatnonzero(solid & (~before[:-1] | first[:-1]))
    after = np.concatenate([solid, [False]])
    ends = np.flatnonzero(solid & (~after[1:] | first[1:])) + 1
    up, down = powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(bounds, starts, "right") - 1


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64): one for 1 to size - 1 words, none without words."""
    powers = Powers()
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None and raw.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        words, doc = word_hashes(body[offsets[at] : offsets[to]], bounds, powers)
        cuts = np.searchsorted(doc, np.arange(to - at + 1))
        n = max(0, len(words) - size + 1)
        codes = np.zeros(n, np.uint64)
        for j in range(size):
            codes = (codes + words[j : j + n]) * np.uint64(0xD1B54A32D192ED03)
        codes = mix(codes)
        for i in range(to - at):
            a, b = cuts[i], cuts[i + 1]
            if b - a >= size:
                yield np.unique(codes[a : b - size + 1])
            elif b > a:
                whole = int(b - a)
                for j in range(a, b):
                    whole = ((whole + int(words[j])) * 0xD1B54A32D192ED03) & _MASK
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = to
