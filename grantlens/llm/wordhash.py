"""Vectorised word hashing over the bytes of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word's hash is a polynomial over its
bytes (each byte first replaced by a random 64-bit value), taken as a
difference of prefix sums, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTES = [_RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]  # both odd: they have an inverse mod 2**64
_POWERS: list[list[np.ndarray]] = [[np.ones(1, _U), np.ones(1, _U)] for _ in range(2)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(lane: int, n: int) -> list[np.ndarray]:
    have = _POWERS[lane]
    if len(have[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE[lane], pow(_BASE[lane], -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            have[i] = np.multiply.accumulate(steps)
    return have


def fold_table(lane: int, lower: bool) -> np.ndarray:
    table = _BYTES[lane].copy()
    if lower:
        table[65:91] = table[97:123]
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and per text the index of its first word (``len + 1`` entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; two lanes together make 128 bits."""
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _powers(lane, len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(fold_table(lane, lower)[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes (runs across texts too: select the valid starts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    rng = np.random.Generator(np.random.PCG64(977 + lane))
    out = np.full(n, width, _U)
    for i, c in enumerate(rng.integers(1, 2**63, width, dtype=np.uint64) | _U(1)):
        out += hashes[i:i + n] * c
    return mix(out)
