"""Removal of repeated word windows with a compressed FM-index per shard.

The index of a shard is the Burrows-Wheeler transform of its fragments in a wavelet matrix of packed bits.
Fragments are streamed through it from right to left: a backward step adds a word to the match; when the
longer string would not occur twice, the match drops words at its right end, as far as the capped LCP
values allow. The lengths of the matches are matching statistics; where they reach the window, the window
is repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from eventgrove.llm.anchors import Symbols, covered, intervals
from eventgrove.llm.suffix_dedup import first_buckets, refined

WINDOW_WORDS = 35
ANCHOR_WORDS = 8
ONE = np.uint64(1)


class WaveletMatrix:
    """Rank queries over a sequence of small integers, one packed bit vector per bit."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.n_bits = max(1, int(largest).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.n_bits):
            bit = (sequence >> (self.n_bits - 1 - level)) & 1 > 0
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, dtype=bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.base = self.descend(np.arange(largest + 1), np.zeros(largest + 1, dtype=np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.n_bits):
            word = at >> 6
            below = self.words[level][word] & ((ONE << (at & 63).astype(np.uint64)) - ONE)
            ones = self.ones[level][word] + np.bitwise_count(below)
            at = np.where((symbol >> (self.n_bits - 1 - level)) & 1 > 0, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.descend(symbol, at) - self.base[symbol]


class FmIndex:
    """An index of a text of integers whose suffixes are sorted by their first ``cap`` symbols. 0 ends a fragment."""

    def __init__(self, text: np.ndarray, cap: int):
        n = len(text)
        self.cap, self.n = cap, n
        room = n - np.arange(n)
        padded = np.r_[text, np.zeros(cap, dtype=text.dtype)]
        # Identifiers by depth: positions past the end compare as the end sign.
        pointers = first_buckets(padded, np.ones(len(padded), dtype=bool))
        by_depth, depth = [(1, pointers)], 1
        space = len(padded) - np.arange(len(padded))
        while depth < cap:
            deeper = min(2 * depth, cap)
            pointers = refined(pointers, space, depth, deeper)
            by_depth.append((deeper, pointers))
            depth = deeper
        self.order = np.argsort(pointers[:n], kind="stable")
        before, after = self.order[:-1], self.order[1:]
        lcp = np.zeros(n - 1 if n else 0, dtype=np.int64)
        for level, held in reversed([(d, p) for d, p in by_depth if d & (d - 1) == 0]):
            for _ in range(2):  # the cap is less than twice the largest power of two below it, plus rests
                a, b = np.minimum(before + lcp, len(padded) - 1), np.minimum(after + lcp, len(padded) - 1)
                fits = (lcp + level <= cap) & (before + lcp + level <= len(padded)) & (after + lcp + level <= len(padded))
                lcp = np.where(fits & (held[a] == held[b]), lcp + level, lcp)
        lcp = np.minimum(lcp, np.minimum(room[before], room[after])) if n else lcp
        self.lcp = np.r_[0, lcp, 0].astype(np.int8 if cap < 128 else np.int32)
        self.least = [self.lcp]  # minima over 2**k values from each place
        while (1 << len(self.least)) <= len(self.lcp):
            half = 1 << (len(self.least) - 1)
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))
        largest = int(text.max(initial=0))
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=largest + 1))]
        self.wavelet = WaveletMatrix(text[self.order - 1], largest)

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after putting a symbol in front."""
        both = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high])
        first = self.smaller[symbol]
        return first + both[: len(low)], first + both[len(low) :]

    def widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of all suffixes that agree with the given ones on ``depth`` symbols."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.least) - 1, -1, -1):
            size, least = 1 << k, self.least[k]
            from_ = np.maximum(low - size + 1, 0)
            go = (low - size >= 0) & (least[np.minimum(from_, len(least) - 1)] >= depth)
            low = np.where(go, low - size, low)
            go = (high + size <= self.n) & (least[np.minimum(high, len(least) - 1)] >= depth)
            high = np.where(go, high + size, high)
        return low, high

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place of the streamed stretches, the longest string there, up to ``cap``, that occurs twice or more in the index."""
        out = np.zeros(len(text), dtype=np.int32)
        at, stop = ends - 1, starts
        low, high, size = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.n), np.zeros(len(at), dtype=np.int64)
        live = np.flatnonzero(at >= stop)
        while len(live):
            lo, hi, n = low[live], high[live], size[live]
            full = np.flatnonzero(n == self.cap)  # room for one more symbol
            if len(full):
                lo[full], hi[full] = self.widened(lo[full], hi[full], n[full] - 1)
                n[full] -= 1
            place = at[live]
            new_lo, new_hi = self.backward(text[place], lo, hi)
            fine = new_hi - new_lo >= 2
            gone = ~fine & (n == 0)
            out[place[fine]] = n[fine] + 1
            low[live], high[live], size[live] = np.where(fine, new_lo, lo), np.where(fine, new_hi, hi), np.where(fine, n + 1, n)
            at[live[fine | gone]] -= 1
            shorter = live[~fine & ~gone]
            if len(shorter):
                depth = np.maximum(self.lcp[low[shorter]], self.lcp[high[shorter]]).astype(np.int64)
                depth = np.minimum(depth, size[shorter] - 1)
                low[shorter], high[shorter] = self.widened(low[shorter], high[shorter], depth)
                size[shorter] = depth
            live = live[at[live] >= stop[live]]
        return out


def search_by_index(data: list[bytes], own: np.ndarray, copies: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the fragments that occur twice or more in the shard, counting copies of a fragment."""
    window = symbols.window
    codes = symbols.cut(b" ".join(data))[0]
    known, ids = np.unique(codes, return_inverse=True)
    sizes = own + window - 1
    text = np.zeros(len(codes) + len(data), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = ids + 1
    statistics = FmIndex(text, window).matching_statistics(text, starts, ends)
    owner = np.repeat(np.arange(len(data)), own)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
    return intervals((statistics[starts[owner] + place] >= window) | (copies[owner] > 1), owner, place)


def repeated_word_windows(df: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, kept, starts, ends) of each text that loses words; ``key_columns`` finds the row it belongs to.

    A word goes if a window of ``window`` words that covers it starts anywhere else, in the same row or
    another, judged on the input. ``kept`` has the other words, joined by one blank; ``starts`` and
    ``ends`` are word numbers. Null texts have no words. Repeated rows are occurrences of their own and
    share one result. An empty table gives an empty one.
    """
    symbols = Symbols("words", window, anchor)

    def finish(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int], list[int]]:
        _, a, b = symbols.cut(data)
        stays = np.zeros(len(a) + 1, dtype=np.int64)
        stays[starts] += 1
        stays[ends] -= 1
        stays = np.cumsum(stays[:-1]) == 0
        return symbols.joined(data, a[stays], b[stays]), starts.tolist(), ends.tolist()

    return covered(df, symbols, search_by_index, finish, "kept binary, starts array<bigint>, ends array<bigint>", id, text)
