"""Polynomial hashes of all substrings of a text (bytes, or an array of symbols) from prefix sums, modulo 2^64."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of the odd multiplier modulo 2^64, by Newton's iteration.
_INVERSE = _ODD
for _ in range(6):
    with np.errstate(over="ignore"):
        _INVERSE = _INVERSE * (np.uint64(2) - _ODD * _INVERSE)


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text so far needed."""

    n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 14)
            self.up = np.cumprod(np.full(self.n, _ODD))
            self.down = np.cumprod(np.full(self.n, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """``of(start, end)``: hashes of the substrings [start, end) of a text, wherever they stand."""

    def __init__(self, text: bytes | np.ndarray):
        n = len(text)
        up, self.down = _POWERS.get(n + 1)
        raw = (np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text).astype(np.uint64) + np.uint64(1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[:n])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """The hash at each place of the substring of ``size`` bytes."""
        n = len(self.sums) - 1
        return mixed((self.sums[size:] - self.sums[: n + 1 - size]) * self.down[: n + 1 - size])
