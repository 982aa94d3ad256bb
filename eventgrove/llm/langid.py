"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound from its
letters' vectors, rotated by their place; a document is the bundle (sum) of its n-grams, a language the
bundle of its training documents. The language whose profile has the largest cosine wins. Bundles are
sums of integers, so profiles do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventgrove.llm.columns import sub_batches, with_arrow_columns

NGRAM = 3
UNKNOWN = "und"
#: N-grams whose vectors are bundled at once: bounds the matrices of a batch.
BLOCK = 4096
#: Bytes of text in one batch.
BATCH = 1 << 20


@dataclass(frozen=True)
class Profiles:
    """Languages and one profile row for each."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    seed: int


class Space:
    """Letter vectors and bundles of one dimension and seed."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, dtype=bool)
        self.is_letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[point] = bits * 2 - 1
        return self.letters[point]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """One vector per row of code points: the letters' vectors, rotated by place and multiplied."""
        points, at = np.unique(grams, return_inverse=True)
        table = np.stack([self.letter(int(p)) for p in points])
        at = at.reshape(grams.shape)
        out = np.ones((len(grams), self.dim), dtype=np.int8)
        for place in range(NGRAM):
            out *= np.roll(table, NGRAM - 1 - place, axis=1)[at[:, place]]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """N-grams as (row, column, count) of a sparse table, and the n-grams' code points by column."""
        cleaned = [" " + t.lower() + " " if t else " " for t in texts]
        points = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in cleaned])
        points = np.where(self.is_letter[points], points, 32)
        again = np.r_[False, (points[1:] == 32) & (points[:-1] == 32) & (doc[1:] == doc[:-1])]
        points, doc = points[~again], doc[~again]
        if len(points) < NGRAM:
            return *(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros((0, NGRAM), dtype=np.int64)
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        small = np.cumsum(seen)[points] - 1
        n, width = len(points) - NGRAM + 1, len(alphabet)
        key = small[:n].copy()
        for place in range(1, NGRAM):
            key = key * width + small[place : place + n]
        inside = doc[:n] == doc[NGRAM - 1 :]
        key, doc = key[inside], doc[:n][inside]
        if width**NGRAM <= 1 << 22:
            present = np.zeros(width**NGRAM, dtype=bool)
            present[key] = True
            grams = np.flatnonzero(present)
            column = (np.cumsum(present) - 1)[key]
        else:
            grams, column = np.unique(key, return_inverse=True)
        cells = doc * len(grams) + column
        if len(texts) * len(grams) <= 1 << 23:
            table = np.bincount(cells, minlength=len(texts) * len(grams))
            filled = np.flatnonzero(table)
            number = table[filled]
        else:
            filled, number = np.unique(cells, return_counts=True)
        spelled = np.empty((len(grams), NGRAM), dtype=np.int64)
        for place in range(NGRAM - 1, -1, -1):
            spelled[:, place] = alphabet[grams % width]
            grams = grams // width
        return filled // max(1, len(spelled)), filled % max(1, len(spelled)), number, spelled

    def bundle(self, rows: np.ndarray, columns: np.ndarray, number: np.ndarray, grams: np.ndarray, n_rows: int) -> np.ndarray:
        """Sum of the n-gram vectors of each row, in blocks of n-grams. Exact: sums stay below 2**24 a block."""
        out = np.zeros((n_rows, self.dim))
        order = np.argsort(columns, kind="stable")
        rows, columns, number = rows[order], columns[order], number[order]
        edges = np.searchsorted(columns, np.arange(0, len(grams) + BLOCK, BLOCK))
        kind = np.float32 if number.sum() < 1 << 24 else np.float64
        for k, start in enumerate(range(0, len(grams), BLOCK)):
            part = slice(edges[k], edges[k + 1])
            block = grams[start : start + BLOCK]
            table = np.zeros((n_rows, len(block)), dtype=kind)
            table[rows[part], columns[part] - start] = number[part]
            out += table @ self.bind(block).astype(kind)
        return out


_spaces: dict[tuple[int, int], Space] = {}


def space(dim: int, seed: int) -> Space:
    """One letter table per worker process."""
    if (dim, seed) not in _spaces:
        _spaces[dim, seed] = Space(dim, seed)
    return _spaces[dim, seed]


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", dim: int = 1024, seed: int = 7) -> Profiles:
    """Profiles from all rows with a language and a text with letters.

    Each task bundles its rows by language; the bundles are added in Spark. What reaches the driver is
    one number per language and dimension. Null languages and texts are left out; an empty table gives no profile.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        here = space(dim, seed)
        for batch in sub_batches(batches, "text", BATCH):
            names, of = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            row, column, number, grams = here.counts(batch.column(1).to_pylist())
            cell = of[row] * max(1, len(grams)) + column
            cells, at = np.unique(cell, return_inverse=True)
            summed = np.bincount(at, weights=number, minlength=len(cells)).astype(np.int64)
            made = here.bundle(cells // max(1, len(grams)), cells % max(1, len(grams)), summed, grams, len(names))
            for name, vector in zip(names, made):
                total[name] = total.get(name, 0) + vector
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "axis", "value"]
            )

    parts = rows.mapInArrow(partial, "lang string, axis int, value bigint")
    cells = parts.groupBy("lang", "axis").agg(F.sum("value").alias("value")).collect()
    names = sorted({c["lang"] for c in cells})
    vectors = np.zeros((len(names), dim))
    for c in cells:
        vectors[names.index(c["lang"]), c["axis"]] = c["value"]
    real = np.linalg.norm(vectors, axis=1) > 0
    return Profiles(tuple(n for n, r in zip(names, real) if r), vectors[real], seed)


def predict_language(
    df: DataFrame, profiles: Profiles, text: str = "text", predicted: str = "lang_pred", score: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """``df`` (or its columns ``keep``) with the language of the nearest profile and the cosine, 0 if negative.

    A text that is null or has no letter, or any text if there is no profile, is ``und`` with score 0; of
    equally near languages the first in the alphabet wins. Columns with the new names are replaced.
    """
    dim = profiles.vectors.shape[1] if len(profiles.languages) else 1
    unit = profiles.vectors / np.linalg.norm(profiles.vectors, axis=1, keepdims=True) if len(profiles.languages) else profiles.vectors

    def compute(texts: pa.Array) -> list[pa.Array]:
        names, scores = [], []
        values = texts.to_pylist()
        here = space(dim, profiles.seed)
        row, column, number, grams = here.counts(values)
        has_letter = np.zeros(len(values), dtype=bool)
        lettered = (grams != 32).any(axis=1)
        has_letter[row[lettered[column]]] = True
        vectors = here.bundle(row, column, number, grams, len(values))
        norms = np.linalg.norm(vectors, axis=1)
        cosines = (vectors @ unit.T) / np.where(norms > 0, norms, 1)[:, None] if len(profiles.languages) else np.zeros((len(values), 1))
        best = cosines.argmax(axis=1)
        for i, found in enumerate(has_letter & (len(profiles.languages) > 0)):
            names.append(profiles.languages[best[i]] if found else UNKNOWN)
            scores.append(min(1.0, max(0.0, float(cosines[i, best[i]]))) if found else 0.0)
        return [pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())]

    return with_arrow_columns(df, text, {predicted: T.StringType(), score: T.DoubleType()}, compute, keep, BATCH)


def fold(id: Column, folds: int = 3) -> Column:
    """Fold of a row: crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds
