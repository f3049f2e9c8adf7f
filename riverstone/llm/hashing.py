"""64-bit hashes of byte segments, in numpy, and the comparison of bytes behind equal hashes.

segment_hashes() tells segments apart; whoever acts on equal hashes compares bytes with equal_segments(). prefix_sums() gives hashes of all
windows of one length by polynomials modulo 2**64, which structured bytes can make collide: they only choose and gather, they decide nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np

BYTE = np.random.Generator(np.random.Philox(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Segments of more bytes are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The base's and its inverse's powers, as far as n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _BASE_INVERSE)):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """len(data) + 1 sums of byte values times powers of the base."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data) + 1)[0][: len(data)])])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def segment_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[begin:end], the same for the same bytes anywhere: eight bytes at a time go through a mixer that isn't linear."""
    n = end - begin
    h = mixed(n.astype(np.uint64) * BASE)
    eights = _eights(data)
    left = np.flatnonzero(n <= LONG)
    at = 0
    while len(left):
        left = left[n[left] > at]
        x = eights[begin[left] + at] & _MASK[np.minimum(n[left] - at, 8)]
        h[left] = mixed((h[left] ^ x) * BASE + np.uint64(at))
        at += 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    return h


def equal_segments(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of a and of b from these places on are the same, for each row."""
    same = np.ones(len(n), bool)
    x, y = _eights(a), _eights(b)
    left = np.flatnonzero(n <= LONG)
    at = 0
    while len(left):
        left = left[n[left] > at]
        mask = _MASK[np.minimum(n[left] - at, 8)]
        same[left] &= (x[at_a[left] + at] & mask) == (y[at_b[left] + at] & mask)
        at += 8
    for i in np.flatnonzero(n > LONG).tolist():
        same[i] = np.array_equal(a[at_a[i] : at_a[i] + n[i]], b[at_b[i] : at_b[i] + n[i]])
    return same
