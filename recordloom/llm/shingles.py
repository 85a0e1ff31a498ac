"""Hashes of words and word shingles, computed on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# One fixed random word per byte value, and one odd factor per place in a shingle.
BYTE_WORDS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
CHUNK = 1 << 19
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {BASE: np.ones(1, np.uint64), UNBASE: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (murmur finalizer)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base`` up to n at least."""
    if len(_powers[base]) <= n:
        _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, CHUNK), base))])
    return _powers[base]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, in order; ASCII letters count as lower case."""
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (size == 0 or size + len(texts[upto]) < CHUNK):
            size += len(texts[upto]) + 1
            upto += 1
        data = np.frombuffer(b" ".join(texts[at:upto]).lower() + b" ", np.uint8)
        space = SPACES[data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        first, last = edge[0::2], edge[1::2]
        scaled = BYTE_WORDS[data] * powers(BASE, len(data))[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scaled)])
        hashes = mix((sums[last] - sums[first]) * powers(UNBASE, len(data))[first])
        ends = np.cumsum([len(t) + 1 for t in texts[at:upto]])
        yield from np.split(hashes, np.searchsorted(first, ends[:-1]))
        at = upto


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    if len(words) < width:
        total = (words * PLACES[: len(words)]).sum(keepdims=True)
        return mix(total + PLACES[width + len(words)])
    n = len(words) - width + 1
    total = words[:n] * PLACES[0]
    for k in range(1, width):
        total += words[k : k + n] * PLACES[k]
    return np.unique(mix(total))
