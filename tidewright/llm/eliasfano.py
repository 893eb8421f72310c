"""Monotone sequences in Elias-Fano form, over memory-mapped arrays, with vectorised access and successor search.

Of n values below u, the lowest log2(u / n) bits of each lie packed side by side; the rest is written in unary: a one for each
value, a zero for each step of the high part. A directory of ones before each 512 bits finds the i-th one or zero.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ONES = _BITS.sum(axis=1)
#: Place of the k-th one (zero) in each byte.
_SELECT = {1: np.zeros((256, 8), dtype=np.int64), 0: np.zeros((256, 8), dtype=np.int64)}
for _byte in range(256):
    for _bit, _table in _SELECT.items():
        _at = np.flatnonzero(_BITS[_byte] == _bit)
        _table[_byte, : len(_at)] = _at


class EliasFano:
    """n values, not falling; `low`, `high` and `ones` may be memory-mapped."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, dtype=U64)
        if width and n:
            part = values & U64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, off = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << off)
            over = (off + U64(width)) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - off[over]))
        tops = (values >> U64(width)).astype(np.int64) + np.arange(n)
        size = (int(tops[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 512) * 512, dtype=np.uint8)
        bits[tops] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[high].reshape(-1, 64).sum(axis=1))])
        return cls(n, width, low, high, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the unary part."""
        before = self.ones if bit else np.arange(len(self.ones)) * 512 - self.ones
        block = np.minimum(np.searchsorted(before, k, side="right") - 1, len(self.ones) - 2)
        left = k - before[block]
        rows = np.asarray(self.high).reshape(-1, 64)[block]
        counts = _ONES[rows] if bit else 8 - _ONES[rows]
        running = np.cumsum(counts, axis=1)
        byte = np.minimum((running <= left[:, None]).sum(axis=1), 63)
        at = np.arange(len(k))
        left = left - (running[at, byte] - counts[at, byte])
        return block * 512 + byte * 8 + _SELECT[bit][rows[at, byte], np.clip(left, 0, 7)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=U64)
        at = i.astype(np.int64) * self.width
        word, off = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> off
        over = off > U64(64 - self.width)
        out[over] |= self.low[word[over] + 1] << (U64(64) - off[over])
        return out & U64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self._select(i, 1) - i).astype(U64) << U64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the place of the first value that is not smaller, and whether it equals x."""
        x = x.astype(U64)
        if not self.n:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        top = (x >> U64(self.width)).astype(np.int64)
        most = int(self._select(np.array([self.n - 1]), 1)[0]) - (self.n - 1)  # high part of the last value
        inside = top <= most
        top = np.minimum(top, most)
        begin = np.where(top > 0, self._select(np.maximum(top - 1, 0), 0) - (top - 1), 0)
        # the zero after the last value's high part may lie past the written bits: there, all values come before it
        end = np.where(top < most, self._select(np.minimum(top, max(0, most - 1)), 0) - top, self.n)
        want = x & U64((1 << self.width) - 1)
        lo, hi = begin.copy(), end.copy()
        while (open_ := lo < hi).any():  # inside a run of equal high parts the low parts do not fall
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) >> 1
            less = self._low(mid) < want[at]
            lo[at[less]] = mid[less] + 1
            hi[at[~less]] = mid[~less]
        found = np.zeros(len(x), dtype=bool)
        real = np.flatnonzero(inside & (lo < end))
        found[real] = self._low(lo[real]) == want[real]
        return np.where(inside, lo, self.n), found
