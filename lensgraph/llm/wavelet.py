"""Two-dimensional range reporting over the points of a permutation, by a wavelet tree in its pointerless form.

Level by level, from the highest bit of a value down, the values are parted stably by that bit, zeros first; a level keeps
how many zeros stand before each place. An interval of places goes on to its zeros and to its ones, and only to those
whose values can lie in the asked range, so a query costs its answers times the number of bits. Many queries go at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Queries that go down the tree together.
TOGETHER = 1 << 17


class WaveletTree:
    """values: a permutation of 0..m-1; the value at place x is the point (x, values[x])."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros = np.zeros((self.bits, len(values) + 1), np.int32)
        for level in range(self.bits):
            zero = values >> (self.bits - 1 - level) & 1 == 0
            np.cumsum(zero, out=self.zeros[level, 1:])
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, low_x: np.ndarray, high_x: np.ndarray, low_y: np.ndarray, high_y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, value) of every point with low_x <= x < high_x and low_y <= value < high_y, some queries at a time."""
        for a in range(0, len(low_x), TOGETHER):
            yield self._down(np.arange(a, min(a + TOGETHER, len(low_x))), low_x, high_x, low_y, high_y)

    def _down(self, query, low_x, high_x, low_y, high_y):
        low, high, value = low_x[query].astype(np.int64), high_x[query].astype(np.int64), np.zeros(len(query), np.int64)
        for level in range(self.bits):
            zeros, left = self.zeros[level], self.bits - 1 - level
            zero_low, zero_high, total = zeros[low].astype(np.int64), zeros[high].astype(np.int64), int(zeros[-1])
            parts = []
            for bit, start, end in ((0, zero_low, zero_high), (1, total + low - zero_low, total + high - zero_high)):
                child = value << 1 | bit
                on = (start < end) & (child << left < high_y[query]) & (child + 1 << left > low_y[query])
                parts.append((query[on], start[on], end[on], child[on]))
            query, low, high, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        return query, value
