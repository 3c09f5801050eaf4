"""Rolling 64-bit hashes over byte arrays, in numpy.

A byte string hashes to ``sum(T[c_k] * B**k) mod 2**64`` with a random table T
and an odd B; prefix sums give every substring's hash in constant time.
"""

from __future__ import annotations

import numpy as np

B = 0xB5026F5AA96619E9 | 1
B_INVERSE = pow(B, -1, 2**64)
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Substring hashes of one byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(B, n), out=self.prefix[1:])
        self.unshift = powers(B_INVERSE, n + 1)

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes."""
        count = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:count]) * self.unshift[:count])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.unshift[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
