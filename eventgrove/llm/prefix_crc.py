"""CRC-32 of any substring from the running CRCs of one scan.

Without its constants the CRC is linear over GF(2): the register after a string is the register after
its front, shifted by the length of the rest, xor the register of the rest alone. So with ``P[i]`` the
register after the first ``i`` bytes, the bytes ``i..j`` alone have the register ``P[j] ^ shift(P[i], j - i)``.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
#: Bytes that one lane of the scan holds, and the longest shift with a table of its own.
LANE = 64


@cache
def byte_table() -> np.ndarray:
    """Register after one byte, from an empty register."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def zero_byte(register: np.ndarray) -> np.ndarray:
    return byte_table()[register & np.uint32(255)] ^ (register >> np.uint32(8))


def operator(images: np.ndarray) -> np.ndarray:
    """Tables (4 x 256) of the linear map that sends bit ``i`` to ``images[i]``."""
    values = np.arange(256)
    out = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> (bit % 8) & 1, images[bit], np.uint32(0)).astype(np.uint32)
    return out


def apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    parts = register.view(np.uint8).reshape(-1, 4) if register.flags.c_contiguous else np.ascontiguousarray(register).view(np.uint8).reshape(-1, 4)
    return tables[0][parts[:, 0]] ^ tables[1][parts[:, 1]] ^ tables[2][parts[:, 2]] ^ tables[3][parts[:, 3]]


@cache
def short_shifts() -> np.ndarray:
    """Flat tables of the shifts by 0..LANE bytes, one of 4 x 256 after the other."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = []
    for _ in range(LANE + 1):
        out.append(operator(images))
        images = zero_byte(images)
    return np.concatenate([t.reshape(-1) for t in out])


@cache
def long_shift(power: int) -> np.ndarray:
    """Tables of the shift by ``LANE << power`` bytes."""
    half = short_shifts()[LANE * 1024 :].reshape(4, 256) if power == 0 else long_shift(power - 1)
    if power == 0:
        return half
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return operator(apply(half, apply(half, bits)))


def shift(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after ``length`` more zero bytes each."""
    register = np.ascontiguousarray(register, dtype=np.uint32)
    blocks = length // LANE
    power = 0
    while blocks.any():
        at = np.flatnonzero(blocks & 1)
        if len(at):
            register = register.copy()
            register[at] = apply(long_shift(power), register[at])
        blocks = blocks >> 1
        power += 1
    tables, parts = short_shifts(), register.view(np.uint8).reshape(-1, 4)
    base = (length % LANE) * 1024
    return tables[base + parts[:, 0]] ^ tables[base + 256 + parts[:, 1]] ^ tables[base + 512 + parts[:, 2]] ^ tables[base + 768 + parts[:, 3]]


class RunningCrc:
    """Running registers of one scan over ``data``; ``of(start, end)`` gives CRCs of its substrings."""

    def __init__(self, data: np.ndarray) -> None:
        lanes = max(-(-len(data) // LANE), 1)
        padded = np.zeros(lanes * LANE, dtype=np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        table, register = byte_table(), np.zeros(lanes, dtype=np.uint32)
        self.local = np.empty((LANE, lanes), dtype=np.uint32)
        for j in range(LANE):  # all lanes take their j-th byte
            register = table[(register ^ columns[j]).astype(np.uint8)] ^ (register >> np.uint32(8))
            self.local[j] = register
        # Registers at the lane starts: a scan by doubling, each step a shift twice as long.
        whole, step, power = register.copy(), 1, 0
        while step < lanes:
            whole[step:] ^= apply(long_shift(power), whole[:-step])
            step, power = step * 2, power + 1
        self.before = np.zeros(lanes, dtype=np.uint32)
        self.before[1:] = whole[:-1]

    def prefix(self, at: np.ndarray) -> np.ndarray:
        """Registers after the first ``at`` bytes."""
        last = np.maximum(at - 1, 0)
        lane, column = last // LANE, last % LANE
        found = self.local[column, lane] ^ shift(self.before[lane], column + 1)
        return np.where(at > 0, found, np.uint32(0)).astype(np.uint32)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of ``data[start:end]`` each; the constants go in as a register of ones."""
        if not len(start):
            return np.zeros(0, dtype=np.uint32)
        return self.prefix(end) ^ shift(self.prefix(start) ^ ONES, end - start) ^ ONES
