"""Elias-Fano lists: n non-decreasing numbers up to u in about 2 + log2(u / n) bits each.

The low bits of each number are packed; the high bits are written in unary, as one set bit per number
in a bit array, at (high bits + index). ``select`` of the i-th set bit gives number i back. Its directory
has the place of every 128th set bit, as 32-bit integers; the rest is counted byte by byte.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQBxxxxxxx")
SAMPLE = 128

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
ONES_IN = _BITS.sum(axis=1).astype(np.int64)
#: Place of the k-th set bit of a byte.
PLACE_IN = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


def _low_bits(n: int, universe: int) -> int:
    return max((universe // n).bit_length() - 1, 0) if n else 0


def _sizes(n: int, universe: int) -> tuple[int, int, int, int]:
    """(low bits, bytes of the low part, of the high part, samples)."""
    low = _low_bits(n, universe)
    return low, -(-n * low // 8), -(-(n + (universe >> low) + 1) // 8) if n else 0, -(-n // SAMPLE)


def encode(values: np.ndarray, universe: int) -> bytes:
    """``values``: unsigned, non-decreasing, none above ``universe``."""
    values = values.astype(np.uint64)
    n = len(values)
    low, _, high_bytes, _ = _sizes(n, universe)
    if n == 0:
        return HEAD.pack(0, universe, 0)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lows = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n) if low < 64 else np.arange(n)
    marks = np.zeros(high_bytes * 8, dtype=np.uint8)
    marks[places] = 1
    return HEAD.pack(n, universe, low) + lows + np.packbits(marks, bitorder="little").tobytes() + places[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """A list read from ``buffer`` at ``at``; ``end`` is the byte behind it."""

    def __init__(self, buffer: bytes, at: int = 0) -> None:
        self.n, self.universe, stated = HEAD.unpack_from(buffer, at)
        self.low, low_bytes, high_bytes, samples = _sizes(self.n, self.universe)
        if self.n and stated != self.low:
            raise ValueError("not an Elias-Fano list")
        at += HEAD.size
        padded = np.zeros(low_bytes + 9, dtype=np.uint8)
        padded[:low_bytes] = np.frombuffer(buffer, np.uint8, low_bytes, at)
        self.lows = padded
        self.highs = np.frombuffer(buffer, np.uint8, high_bytes, at + low_bytes)
        self.samples = np.frombuffer(buffer, "<u4", samples, at + low_bytes + high_bytes)
        self.end = at + low_bytes + high_bytes + 4 * samples

    def select(self, index: np.ndarray) -> np.ndarray:
        """Places of the set bits number ``index`` in the unary part."""
        index = np.asarray(index, dtype=np.int64)
        place = self.samples[index // SAMPLE].astype(np.int64)
        byte, left = place >> 3, index % SAMPLE
        # The ones of the first byte that lie before the sample count as not yet passed.
        below = (np.int64(1) << (place & 7)) - 1
        left = left + ONES_IN[self.highs[byte] & below.astype(np.uint8)]
        open_ = np.flatnonzero(left >= ONES_IN[self.highs[byte]])
        while len(open_):
            left[open_] -= ONES_IN[self.highs[byte[open_]]]
            byte[open_] += 1
            open_ = open_[left[open_] >= ONES_IN[self.highs[byte[open_]]]]
        return byte * 8 + PLACE_IN[self.highs[byte], left]

    def get(self, index: np.ndarray) -> np.ndarray:
        """Numbers at ``index``, as unsigned 64-bit integers."""
        index = np.asarray(index, dtype=np.int64)
        if not len(index):
            return np.zeros(0, dtype=np.uint64)
        high = (self.select(index) - index).astype(np.uint64)
        if self.low == 0:
            return high
        bit = index * self.low
        byte, off = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(index), dtype=np.uint64)
        for k in range(8):
            word |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        ninth = self.lows[byte + 8].astype(np.uint64)
        word = (word >> off) | np.where(off > 0, ninth << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        if self.low == 64:
            return word
        return (high << np.uint64(self.low)) | (word & np.uint64((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))
