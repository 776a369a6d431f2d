"""Winnowed anchors of byte strings.

Every string of `span` bytes holds at least one anchor, and equal strings hold
it at the same place: of the `k`-byte substrings that start in it, the one with
the least hash (the leftmost of equals). Texts are hashed together, up to some
MB at a time.
"""

from __future__ import annotations

import numpy as np

from .shingles import Powers, mix

#: Places looked at together; a hash keeps 48 bits beside the 16 of a place.
BLOCK = 1 << 15
_PLACE = np.uint64(0xFFFF)
_powers = Powers()


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes times powers of a base, from the front, and the inverse powers: (sums[b] - sums[a]) * down[a] names data[a:b]."""
    up, down = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return sums, down


def anchors(data: np.ndarray, bounds: np.ndarray, k: int, span: int, sums: np.ndarray | None = None, down: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in `data` (in order) and their hashes of 48 bits; text i is data[bounds[i]:bounds[i + 1]]."""
    width = span - k + 1  # k-byte substrings in a string of `span` bytes
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if sums is None:
        sums, down = prefix_sums(data)
    strings = len(data) - span + 1
    inside = np.zeros(len(data) + 1, np.int32)  # strings of `span` bytes that lie within one text
    lengths = np.diff(bounds)
    good = lengths >= span
    np.add.at(inside, bounds[:-1][good], 1)
    np.add.at(inside, bounds[1:][good] - span + 1, -1)
    inside = np.cumsum(inside[:strings], dtype=np.int32) > 0
    places, hashes = [], []
    for a in range(0, strings, BLOCK):
        b = min(strings, a + BLOCK)
        if not inside[a:b].any():
            continue
        n = b - a + width - 1
        least = mix((sums[a + k : a + k + n] - sums[a : a + n]) * down[a : a + n])
        least &= ~_PLACE
        least |= np.arange(n, dtype=np.uint64)
        size = 1
        while size < width:  # least of `size` entries from each place on, by doubling; its place comes along in the low bits
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        least = least[inside[a:b]]
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]  # an anchor leads strings one after the other
        places.append((least & _PLACE).astype(np.int64) + a)
        hashes.append(least >> np.uint64(16))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, found = np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    return place[new], found[new]
