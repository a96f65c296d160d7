"""64-bit hashes of many stretches of one text at once.

A stretch's hash is a polynomial in R of its bytes modulo 2^64, mixed.  Sums
up to each byte give the polynomial of every stretch by one subtraction, so
overlapping stretches (shingles) cost no more than separate ones (words).
"""

from __future__ import annotations

import numpy as np

#: Bytes whose stretches are hashed at once; bounds the sums and the tables of powers.
STRETCH = 1 << 18
R = 0x9E3779B97F4A7C15  # any odd number


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (public constants of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """R^j and R^-j modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            for name, r in (("up", R), ("down", pow(R, -1, 2**64))):
                a = np.full(max(n, 1 << 16), r, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


_POWERS = _Powers()


def hash_stretches(octets: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of ``octets[first[i]:last[i]]``, both rising with i."""
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        base = int(first[at])
        stop = int(np.searchsorted(first, base + STRETCH))
        a, b = first[at:stop] - base, last[at:stop] - base
        n = int(b[-1])
        _POWERS.need(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((octets[base : base + n].astype(np.uint64) + np.uint64(1)) * _POWERS.up[:n], out=sums[1:])
        out[at:stop] = mix(mix((sums[b] - sums[a]) * _POWERS.down[a]) ^ (b - a).astype(np.uint64))
        at = stop
    return out
