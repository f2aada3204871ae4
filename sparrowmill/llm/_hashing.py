"""Vectorised 64-bit hashing of words, shingles and byte ranges with NumPy.

A byte range hashes to ``sum(T[b_i] * P**i)`` modulo 2**64, which prefix sums give for every
range at once; a finalizer then spreads the bits.  All of it is fixed, so any machine and any
run gives the same values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finalizer of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.full(1 << max(16, (n - 1).bit_length()), _MULTIPLIER if which == "up" else _INVERSE, np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(base)
        if n <= 1 << 22:  # a single huge text does not pin its tables
            _powers[which] = have
    return have[:n]


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[begin:end]`` for arrays of ranges of one byte buffer."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * _power("up", len(data)), out=total[1:])
        raw = (total[end] - total[begin]) * _power("down", len(data) + 1)[begin]
        return mix(raw + (end - begin).astype(np.uint64))


def sequence_hashes(values: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[first] ... values[last]`` and of the steps between them, which stand before each value."""
    with np.errstate(over="ignore"):
        total = np.cumsum(mix(values ^ mix(steps.astype(np.uint64), 5), 3) * _power("up", len(values)))
        between = (total[last] - total[first]) * _power("down", len(values))[first]
        return mix(between ^ mix(values[first], 9))


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = WHITE[data]
    change = np.flatnonzero(white[1:] != white[:-1])
    return change[0::2], change[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts with a space after each, and the begin of each text in it."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return data, np.concatenate(([0], np.cumsum(sizes)))


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear rolling hash ``h = (h << 1) + G[b]`` after every byte.

    Bits shifted out of 16 leave the hash, so it depends on the last 16 bytes alone; doubling
    windows compute it for a whole buffer in four steps.
    """
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    return h


GEAR = (mix(np.arange(256, dtype=np.uint64), 11) >> U(40)).astype(np.uint16)
