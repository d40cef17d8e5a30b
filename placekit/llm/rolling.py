"""Polynomial hashes of byte ranges, vectorised: hash(a, b) is read off sums of prefixes."""

from __future__ import annotations

import numpy as np

#: An odd base, its inverse modulo 2**64, and the mixer's two factors.
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64; grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) > 1 << 24:  # of a text this long the powers aren't kept
            return have
        _POWERS[base] = have
    return have


def prefixes(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base ** position before each position, and over all."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = _powers(_BASE, len(data))[: len(data)] * (data.astype(np.uint64) + np.uint64(1))
    np.cumsum(terms, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes; equal bytes, equal hashes, wherever they are."""
    n = int(start.max(initial=0)) + 1
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, n)[start])
