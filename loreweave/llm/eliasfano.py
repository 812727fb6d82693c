"""Monotone sequences in Elias-Fano form, searched with numpy over mapped memory."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Place of the k-th one (from 0) of a byte.
_NTH = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _places = [_k for _k in range(8) if _byte >> _k & 1]
    _NTH[_byte, : len(_places)] = _places


def _nth(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word."""
    place = np.zeros(len(x), np.int64)
    for s in (32, 16, 8):
        part = x & np.uint64((1 << s) - 1)
        ones = np.bitwise_count(part)
        go = k >= ones
        k = np.where(go, k - ones, k)
        x = np.where(go, x >> np.uint64(s), part)
        place += s * go
    return place + _NTH[x.astype(np.int64) & 255, k]


class EliasFano:
    """Strictly or weakly ascending values below ``universe``: low bits packed, high
    bits in unary, and the zeros before each word of the unary part counted."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
        parts = []
        for at in range(0, n if bits else 0, 1 << 16):
            part = values[at : at + (1 << 16)]
            rows = np.zeros((len(part) + (-len(part)) % 64, bits), dtype=np.uint8)
            for b in range(bits):
                rows[: len(part), b] = (part >> np.uint64(b)) & _ONE
            parts.append(np.packbits(rows.reshape(-1), bitorder="little"))
        low = np.concatenate([*parts, np.zeros(16, np.uint8)])
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)]).view(np.uint64)
        tops = (values >> np.uint64(bits)).astype(np.int64)
        size = n + ((int(universe) >> bits) if universe else 0) + 2
        unary = np.zeros(size + (-size) % 64 + 64, dtype=np.uint8)
        unary[tops + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)[:-1]])
        zeros = zeros.astype(np.uint32 if zeros[-1] < 1 << 32 else np.int64)
        return cls(n, bits, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> off
        over = off > np.uint64(64 - self.low_bits)
        if over.any():
            got[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return got & np.uint64((1 << self.low_bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the unary part."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        left = k - self.zeros[word].astype(np.int64)
        return word * 64 + _nth(~self.high[word], left)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: the successor in the value's bucket, compared."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(np.uint64)
        top, want = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        start = np.where(top > 0, self._select0(np.maximum(top - 1, 0)) + 1, 0)
        lo = start - top
        word, off = start >> 6, (start & 63).astype(np.uint64)
        seen = self.high[word] >> off
        run = np.bitwise_count(seen & ~(seen + _ONE)).astype(np.int64)
        hi = lo + run
        cut = run >= 64 - (start & 63)  # the bucket may go on in the next word
        if cut.any():
            hi[cut] = self._select0(top[cut]) - top[cut]
        end = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        found = np.full(len(x), -1, np.int64)
        in_bucket = np.flatnonzero(lo < end)
        same = self._low(lo[in_bucket]) == want[in_bucket]
        found[in_bucket[same]] = lo[in_bucket[same]]
        return found

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at indexes."""
        i = i.astype(np.int64)
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, i, side="right") - 1
        left = i - ones[word]
        place = word * 64 + _nth(self.high[word], left)
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(v) for v in arrays[f"{name}.meta"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])
