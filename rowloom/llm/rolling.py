"""Hashes of any stretch of a number row in constant time, by prefix sums modulo 2^64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in place for a fresh array)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: A random 64-bit value for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_IN_WORDS = np.ones(256, bool)
_IN_WORDS[[9, 10, 11, 12, 13, 32]] = False


class _Powers:
    """Powers of the base and of its inverse, kept and grown as rows ask for them."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            size = len(cls.up)
            cls.up = np.concatenate((cls.up, cls.up * np.uint64(pow(_BASE, size, 1 << 64))))
            cls.down = np.concatenate((cls.down, cls.down * np.uint64(pow(_INVERSE, size, 1 << 64))))
        return cls.up, cls.down


class Rolling:
    """Stretch hashes of one row of 64-bit values. Equal stretches have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        up, self.down = _Powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """The hashes of all stretches of one size."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each run of bytes other than ASCII white space, in order."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORDS[np.frombuffer(data, np.uint8)]
    # Bounds take turns: a word starts, a word stops.
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of each word, as ``word_bounds`` has them."""
    starts, stops = word_bounds(data)
    return Rolling(BYTES[np.frombuffer(data, np.uint8)]).of(starts, stops), starts, stops
