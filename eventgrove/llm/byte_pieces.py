"""Ids of the tokenizers library for many texts, with words coded once.

Byte-level tokenizers cut a text before any space that stands alone between two visible characters, so
what lies between such spaces can be coded by itself. Distinct words are coded in bulk and kept; what
cannot be cut (a text's first word, runs of white space, doubtful characters) is coded as it stands.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Characters that one cut of a text holds, about, and that the kept words may hold together.
CUT_CHARS = 1 << 20
HELD_CHARS = 8 << 20
#: Words of one bulk text.
BULK = 1024


def load_tokenizer(path: str) -> str:
    """The tokenizer's JSON, which travels with the task."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def visible(char: str) -> bool:
    """Surely no white space to any engine: letters and digits, and what is printed in ASCII."""
    return "!" <= char <= "~" or (char > "\x7f" and char.isalnum())


def _cuts_at_spaces(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain


class _Words(dict):
    """Number of each word, given on first sight."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class _Grown:
    """An array that grows at its end, with room ahead."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(2 * n - self.n, self.room.dtype)])
        self.room[self.n : n] = values
        self.n = n

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class BytePieces:
    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_word = _cuts_at_spaces(json.loads(spec))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.by_word:
            # "Ġ" is how byte-level vocabularies write a space.
            self.after_space = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
            for token, number in self.tokenizer.get_vocab().items():
                self.after_space[number] = token.startswith("Ġ")
        self._empty()

    def _empty(self) -> None:
        self.words, self.odd, self.held = _Words(), {}, 0
        self.flat, self.start, self.count = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int64)
        self.opens, self.closes, self.used = _Grown(bool), _Grown(bool), _Grown(np.int64)

    def _forget(self) -> None:
        """Keep the words seen more than once, if that makes enough room."""
        again = [(w, n) for w, n in self.words.items() if self.used.room[n] > 1]
        old = self.flat.held, self.start.held, self.count.held, self.opens.held, self.closes.held, self.used.held
        self._empty()
        if sum(len(w) for w, _ in again) > HELD_CHARS // 2:
            return
        number = np.array([n for _, n in again], dtype=np.int64)
        flat, start, count, opens, closes, used = old
        sizes = count[number]
        upto = np.cumsum(sizes)
        self.flat.add(flat[np.repeat(start[number] - (upto - sizes), sizes) + np.arange(sizes.sum())])
        self.start.add(upto - sizes)
        for to, values in ((self.count, sizes), (self.opens, opens[number]), (self.closes, closes[number]), (self.used, used[number] // 2)):
            to.add(values)
        for word, _ in again:
            self.words[word] = len(self.words)
            self.held += len(word)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        if not self.by_word:
            lists = self._library(texts)
            return np.array([i for ids in lists for i in ids], dtype=np.uint32), np.array([len(ids) for ids in lists], dtype=np.int64)
        flats, counts = [], np.zeros(len(texts), dtype=np.int64)
        for at, text in enumerate(texts):
            if len(text) > CUT_CHARS:  # alone, cut by cut
                parts = [self._encode_cuts([cut], [front])[0] for cut, front in self._cuts(text)]
                flats.append(np.concatenate(parts))
                counts[at] = len(flats[-1])
        short = [i for i, text in enumerate(texts) if len(text) <= CUT_CHARS]
        if len(short) == len(texts):
            return self._encode_cuts(texts, [True] * len(texts))
        flat, n = self._encode_cuts([texts[i] for i in short], [True] * len(short))
        counts[short] = n
        pieces, long = np.split(flat, np.cumsum(n)[:-1]) if short else [], iter(flats)
        parts, at = [], 0
        for text in texts:
            if len(text) <= CUT_CHARS:
                parts.append(pieces[at])
                at += 1
            else:
                parts.append(next(long))
        return np.concatenate(parts), counts

    @staticmethod
    def _cuts(text: str):
        """(stretch, whether it is the text's front), cut at single spaces between visible characters."""
        start, front = 0, True
        while len(text) - start > CUT_CHARS:
            at = text.find(" ", start + CUT_CHARS)
            while at > 0 and not (at + 1 < len(text) and visible(text[at - 1]) and visible(text[at + 1])):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at], front
            start, front = at + 1, False
        yield text[start:], front

    def _encode_cuts(self, cuts: list[str], fronts: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > HELD_CHARS:
            self._forget()
        words: list[str] = []
        bounds = np.zeros(len(cuts) + 1, dtype=np.int64)
        for i, cut in enumerate(cuts):
            words += cut.split(" ")
            bounds[i + 1] = len(words)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(cuts), dtype=np.int64)
        number = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        if self.words.fresh:
            self._learn(self.words.fresh)
            self.words.fresh = []
        seen, times = np.unique(number, return_counts=True)
        self.used.room[seen] += times
        first = np.zeros(len(words), dtype=bool)
        first[bounds[:-1]] = True
        bare = np.zeros(len(words), dtype=bool)
        bare[bounds[:-1]] = fronts
        opens, closes = self.opens.held[number], self.closes.held[number]
        begins = first.copy()
        begins[1:] |= closes[:-1] & opens[1:]
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(words))
        plain = (end - begin == 1) & ~bare[begin] & opens[begin] & closes[begin]
        # Stretches coded as they stand, each kept too.
        odd = np.flatnonzero(~plain)
        stretches = [("" if bare[a] else " ") + " ".join(words[a:b]) for a, b in zip(begin[odd].tolist(), end[odd].tolist())]
        fresh = list(dict.fromkeys(s for s in stretches if s not in self.odd))
        for stretch, ids in zip(fresh, self._library(fresh)):
            self.odd[stretch] = np.array(ids, dtype=np.uint32)
            self.held += len(stretch)
        extra = [self.odd[s] for s in stretches]
        sizes = np.array([len(e) for e in extra], dtype=np.int64)
        # What stands by itself lies behind the kept words, for this call only.
        kept = self.flat.n
        self.flat.add(np.concatenate([np.zeros(0, np.uint32), *extra]))
        flat, self.flat.n = self.flat.room, kept
        start, count = self.start.held[number[begin]], self.count.held[number[begin]]
        start[odd] = kept + np.cumsum(sizes) - sizes
        count[odd] = sizes
        upto = np.cumsum(count)
        ids = flat[np.repeat(start - (upto - count), count) + np.arange(upto[-1])]
        per_cut = np.add.reduceat(count, np.searchsorted(begin, bounds[:-1]))
        return ids, per_cut

    def _learn(self, words: list[str]) -> None:
        """Code words seen for the first time, in bulk texts in which each follows a space."""
        opens = np.array([bool(w) and visible(w[0]) for w in words])
        closes = np.array([bool(w) and visible(w[-1]) for w in words])
        usable = [w for w, a, b in zip(words, opens, closes) if a and b]
        bulk = [" " + " ".join(usable[i : i + BULK]) for i in range(0, len(usable), BULK)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(x, dtype=np.uint32) for x in self._library(bulk))])
        starts = np.flatnonzero(self.after_space[flat])
        if len(starts) != len(usable):
            raise ValueError("a word's first piece does not hold its space")
        at = np.flatnonzero(opens & closes)
        start, count = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        start[at] = self.flat.n + starts
        count[at] = np.diff(np.append(starts, len(flat)))
        for to, values in ((self.flat, flat), (self.start, start), (self.count, count), (self.opens, opens), (self.closes, closes), (self.used, np.zeros(len(words), np.int64))):
            to.add(values)
        self.held += sum(map(len, words))


@lru_cache(maxsize=2)
def pieces_of(spec: str) -> BytePieces:
    """One per Python worker, so that words stay known from task to task."""
    return BytePieces(spec)
