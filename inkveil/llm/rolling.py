"""Prefix polynomial hashes of byte strings, in arrays.

A hash is a polynomial in an odd base modulo 2**64 over random values of the
bytes; dividing by the power of the start makes equal strings hash equally
wherever they stand.  ``mix`` spreads the bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_random = np.random.default_rng(20_240_117)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(29))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix hashes: entry i covers the first i bytes."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * p[: len(data)], out=out[1:])
    return out


def spans(prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    _, inverse = powers(len(prefixes))
    return (prefixes[end] - prefixes[start]) * inverse[start]
