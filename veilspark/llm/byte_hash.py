"""Rolling hashes over byte buffers with numpy, shared by operators 6 and 10.

A text's prefix sums of ``TABLE[byte] * BASE**position`` modulo 2**64 give the
hash of any slice in one subtraction and one multiplication by an inverse
power.  Two texts' slices of equal bytes have equal hashes wherever they lie.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (public splitmix64 finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: a random-looking 64-bit value per byte
TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; grown by doubling and kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, dtype=U) if got is None else got
        while len(got) < n:
            got = np.concatenate([got, got * U(pow(base, len(got), 1 << 64))])
        _powers[base] = got if len(got) <= 1 << 19 else _powers.get(base, got[:1])
    return got[:n]


def prefix_sums(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """``n + 1`` prefix sums of a byte array."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end), mixed with their lengths."""
    raw = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all slices of ``size`` bytes, by start."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, dtype=U)
    return mix((sums[size:] - sums[:-size]) * powers(INVERSE, n))
