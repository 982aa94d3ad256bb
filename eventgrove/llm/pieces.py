"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words at the word-start sign; the distinct words that are not cached lie
in one flat symbol array. Each round takes the smallest pair rank of every word (a segmented minimum),
merges the leftmost pair with that rank in all words at once, and compacts the array, until no word
has a pair left. That is the order in which the sentencepiece library merges.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventgrove.llm.columns import with_arrow_columns

SPACE = "▁"
NO_PAIR = np.int64(1) << 40
#: A word with more symbols takes the heap, whose work grows as n log n instead of rounds times symbols.
LONG_WORD = 256
#: Distinct words whose ids a worker keeps between batches.
CACHED_WORDS = 250_000

NORMAL, BYTE = 1, 6


@dataclass(frozen=True)
class PieceModel:
    """Pieces by id, their scores and types, as the model file has them."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """Read a BPE model; other kinds and text normalisers are refused, because merges alone would not match them."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and word-start signs are supported")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    types = tuple(int(p.type) for p in model.pieces)
    if not set(types) <= {1, 2, 3, 6}:
        raise ValueError("user-defined and unused pieces are not supported")
    return PieceModel(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), types)


def slot_of(keys: np.ndarray, size: int) -> np.ndarray:
    """Place of each key in a table whose size is a power of two."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


class PieceCoder:
    """The tables of a model as arrays, and both directions over flat arrays."""

    def __init__(self, model: PieceModel):
        pieces = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == NORMAL}
        chars = sorted({c for p in pieces for c in p} - set(pieces))
        symbols = dict(pieces)
        for c in chars:  # occurs inside pieces only
            symbols[c] = len(model.pieces) + len(symbols)
        self.other = 2 * len(model.pieces) + len(chars) + 1  # any further character
        self.width = self.other + 1
        self.symbols, self.n_pieces = symbols, len(model.pieces)
        ranks = {s: r for r, s in enumerate(sorted({model.scores[i] for i in pieces.values()}, reverse=True))}
        merges = {
            symbols[p[:k]] * self.width + symbols[p[k:]]: (ranks[model.scores[i]], i)
            for p, i in pieces.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        }
        self.merges = merges
        self.pair_keys = np.array(sorted(merges), dtype=np.int64)
        found = [merges[k] for k in self.pair_keys.tolist()]
        self.pair_ranks = np.array([r for r, _ in found], dtype=np.int64)
        self.pair_ids = np.array([i for _, i in found], dtype=np.int64)
        self.slots = self.hash_slots()
        points = [(ord(s), i) for s, i in symbols.items() if len(s) == 1]
        self.by_point = np.full(max((p for p, _ in points), default=0) + 2, self.other, dtype=np.int64)
        for point, i in points:
            self.by_point[point] = i
        bytes_of = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == BYTE}
        self.byte_ids = np.array([bytes_of[b] for b in range(256)], dtype=np.int64)
        # Without a piece that holds the sign after another character, no merge crosses that place.
        crossing = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not crossing else re.compile(".+", re.DOTALL)
        self.cache: dict[str, int] = {}
        self.known_ids, self.known_ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        raw = []
        for p, t in zip(model.pieces, model.types):
            raw.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t not in (NORMAL, BYTE) and t != 2 else " ⁇ ".encode() if t == 2 else p.replace(SPACE, " ").encode())
        self.raw = np.frombuffer(b"".join(raw) or b"\0", dtype=np.uint8)
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_starts, self.raw_sizes = np.cumsum(sizes) - sizes, sizes
        self.starts_with_space = np.array([t == NORMAL and p.startswith(SPACE) for p, t in zip(model.pieces, model.types)], dtype=bool)

    def hash_slots(self) -> np.ndarray:
        """Index of each pair key at its hashed place or the next free one; -1 marks free places."""
        slots = np.full(1 << (4 * len(self.pair_keys)).bit_length(), -1, dtype=np.int32)
        for at, place in enumerate(slot_of(self.pair_keys, len(slots)).tolist()):
            while slots[place] >= 0:
                place = (place + 1) % len(slots)
            slots[place] = at
        return slots

    # -- encoding ---------------------------------------------------------------------------------

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of symbol pairs; NO_PAIR where the model has none."""
        keys = left * self.width + right
        place = slot_of(keys, len(self.slots))
        at = self.slots[place]
        hit = self.pair_keys[at] == keys
        rest = np.flatnonzero(~hit & (at >= 0))
        while len(rest):
            place[rest] = (place[rest] + 1) % len(self.slots)
            at[rest] = self.slots[place[rest]]
            hit[rest] = self.pair_keys[at[rest]] == keys[rest]
            rest = rest[~hit[rest] & (at[rest] >= 0)]
        hit &= at >= 0
        return np.where(hit, self.pair_ranks[at], NO_PAIR), self.pair_ids[at]

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final (symbols, word of each, position of each symbol's first character), ordered by word."""
        first_char = np.arange(len(symbols))
        rank = np.full(len(symbols), NO_PAIR)
        merged = np.zeros(len(symbols), dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], merged[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(least < NO_PAIR, sizes)
            if not open_.all():
                shut = ~open_
                done.append((symbols[shut], word[shut], first_char[shut]))
                symbols, word, rank, merged, first_char = symbols[open_], word[open_], rank[open_], merged[open_], first_char[open_]
                if not len(symbols):
                    break
                keep = least < NO_PAIR
                least, sizes = least[keep], sizes[keep]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # leftmost of each word
            symbols[at] = merged[at]
            alive = np.ones(len(symbols), dtype=bool)
            alive[at + 1] = False
            new_at = at - np.arange(len(at))  # each word before has lost one symbol
            symbols, word, rank, merged, first_char = symbols[alive], word[alive], rank[alive], merged[alive], first_char[alive]
            for changed in (new_at, new_at - 1):
                left = changed[changed >= 0]
                right = np.minimum(left + 1, len(symbols) - 1)
                same = (right > left) & (word[left] == word[right])
                found, ids = self.look_up(symbols[left], symbols[right])
                rank[left], merged[left] = np.where(same, found, NO_PAIR), ids
        if not done:
            return symbols, word, first_char
        out = tuple(np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(out[1], kind="stable")
        return out[0][order], out[1][order], out[2][order]

    def merge_long(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one very long word, with a heap over (rank, position)."""
        ids = symbols.tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get(ids[i] * self.width + ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.merges[a * self.width + b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        at = np.flatnonzero(np.array(alive))
        return np.array(ids, dtype=np.int64)[at], at

    def to_ids(self, symbols: np.ndarray, word: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids with byte fallback for characters that are no piece."""
        odd = symbols >= self.n_pieces
        if not odd.any():
            return symbols, word
        sizes = np.ones(len(symbols), dtype=np.int64)
        spelled = [chr(p).encode("utf-8", "surrogatepass") for p in points[odd].tolist()]
        sizes[odd] = [len(x) for x in spelled]
        out = np.repeat(symbols, sizes)
        out[np.repeat(odd, sizes)] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        return out, np.repeat(word, sizes)

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        symbols = np.where(points < len(self.by_point) - 1, self.by_point[np.minimum(points, len(self.by_point) - 1)], self.other)
        word = np.repeat(np.arange(len(words)), sizes)
        long_word = sizes > LONG_WORD
        if long_word.any():
            short = ~long_word[word]
            at = np.flatnonzero(short)
            parts = [(lambda s, w, f: (s, w, at[f]))(*self.merge_rounds(symbols[short], word[short]))]
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(long_word).tolist():
                start = int(ends[k] - sizes[k])
                got, where = self.merge_long(symbols[start : ends[k]])
                parts.append((got, np.full(len(got), k), where + start))
            merged, of, first = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(of, kind="stable")
            merged, of, first = merged[order], of[order], first[order]
        else:
            merged, of, first = self.merge_rounds(symbols, word)
        ids, of = self.to_ids(merged, of, points[first])
        return ids.astype(np.int32), np.bincount(of, minlength=len(words))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; null counts as empty."""
        cut = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = list(chain.from_iterable(cut))
        new = list(set(words) - self.cache.keys())
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            self.known_ids, self.known_ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
            new = list(set(words))
        if new:
            ids, sizes = self.encode_words(new)
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
            self.known_ends = np.r_[self.known_ends, self.known_ends[-1] + np.cumsum(sizes)]
            self.known_ids = np.r_[self.known_ids, ids]
        at = np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))
        begin, sizes = self.known_ends[at], self.known_ends[at + 1] - self.known_ends[at]
        ends = np.cumsum(sizes)
        total = np.r_[0, ends]
        where = np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])
        edges = np.cumsum([0, *(len(c) for c in cut)])
        return self.known_ids[where], np.diff(total[edges])

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids. Unknown bytes become U+FFFD, control ids nothing."""
        starts_of_text = np.cumsum(counts) - counts
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.raw_starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.raw[where].tobytes()
        edges = np.r_[0, ends]
        begin, stop = edges[starts_of_text], edges[starts_of_text + counts]
        full = counts > 0
        begin = begin.copy()
        begin[full] += self.starts_with_space[ids[starts_of_text[full]]]  # the space that encoding put in front
        return [utf8(data[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]


def utf8(data: bytes) -> str:
    """Decode, with one U+FFFD for each byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        parts = []
        while data:
            try:
                parts.append(data.decode())
                break
            except UnicodeDecodeError as e:
                parts.append(data[: e.start].decode() + "�")
                data = data[e.start + 1 :]
        return "".join(parts)


_coders: dict[int, tuple[PieceModel, PieceCoder]] = {}


def coder_of(model: PieceModel) -> PieceCoder:
    """One coder per model and worker process."""
    key = hash(model)
    if key not in _coders or _coders[key][0] != model:
        _coders[key] = (model, PieceCoder(model))
    return _coders[key][1]


def encode_pieces(df: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text, as the sentencepiece library encodes it, without begin and end ids.

    Null and empty texts have no ids. A column already named ``ids`` is replaced. Rows are independent:
    repeated rows and long texts need nothing special, a batch holds 2 MB of text or one longer text.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        flat, counts = coder_of(model).encode(texts.to_pylist())
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))]

    return with_arrow_columns(df, text, {ids: T.ArrayType(T.IntegerType())}, compute)


def round_trip_pieces(df: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` of the ids in one pass, which needs half the workers of two."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        coder = coder_of(model)
        flat, counts = coder.encode(texts.to_pylist())
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32())), pa.array(coder.decode(flat, counts), type=pa.string())]

    return with_arrow_columns(df, text, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, compute, keep)


def decode_pieces(df: DataFrame, model: PieceModel, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the text of each array of ids; null and empty arrays give an empty text, null ids are skipped.

    A column already named ``decoded`` is replaced; an id outside the vocabulary is an error.
    """

    def compute(values: pa.Array) -> list[pa.Array]:
        values = pa.array(values.to_pylist(), type=pa.list_(pa.int32())) if values.null_count or values.flatten().null_count else values
        flat = values.flatten()
        lengths = pa.compute.list_value_length(values).fill_null(0)
        counts = np.asarray(lengths, dtype=np.int64)
        numbers = np.asarray(flat.fill_null(-1), dtype=np.int64)
        if (numbers < 0).any():
            of = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(of[numbers >= 0], minlength=len(counts))
            numbers = numbers[numbers >= 0]
        return [pa.array(coder_of(model).decode(numbers, counts), type=pa.string())]

    sized = df.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    return with_arrow_columns(sized, ids, {decoded: T.StringType()}, compute, keep)
