"""Expressions on ``array<float>`` / ``array<double>`` columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventgrove.functions.let import let
from eventgrove.functions.tokens import positions_where

ZERO = 0.0


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_norm(vector: Column) -> Column:
    return F.aggregate(as_double(vector), F.lit(ZERO), lambda s, x: s + x * x)


def distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(ZERO), lambda s, x: s + x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(
        F.sqrt(squared_norm(vector)),
        body=lambda norm: F.transform(as_double(vector), lambda x: F.when(norm > 0, x / norm).otherwise(x)),
    )


def mean_of(vectors: Column) -> Column:
    """Elementwise mean of an array of equally long vectors; null when there is none."""

    def mean(vectors: Column, n: Column) -> Column:
        summed = F.aggregate(
            F.slice(vectors, 2, F.greatest(n, F.lit(1))),
            as_double(F.get(vectors, F.lit(0))),
            lambda acc, v: F.zip_with(acc, as_double(v), lambda x, y: x + y),
        )
        return F.when(n > 0, F.transform(summed, lambda x: x / n))

    return let(vectors, body=lambda vectors: let(F.size(vectors), body=lambda n: mean(vectors, n)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean over the positions whose mask is 1, the count clamped at 1e-9."""
    width = F.size(F.get(vectors, F.lit(0)))
    zero = F.array_repeat(F.lit(ZERO), width)
    rows = F.zip_with(vectors, mask, lambda v, m: F.struct(as_double(v).alias("v"), m.cast("double").alias("m")))
    summed = F.aggregate(rows, zero, lambda acc, row: F.zip_with(acc, row["v"], lambda x, y: x + y * row["m"]))
    kept = F.greatest(F.aggregate(mask, F.lit(ZERO), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    return let(kept, body=lambda kept: F.transform(summed, lambda x: x / kept))


def present(*sources: Column) -> Column:
    return F.filter(F.array(*[as_double(s) for s in sources]), lambda v: v.isNotNull())


def has_nan(vector: Column) -> Column:
    return F.exists(as_double(vector), lambda x: F.isnan(x))


def pieces_by_word(word_ids: Column) -> Column:
    """Array of piece positions per word; pieces without a word (special tokens) are left out."""
    last = F.array_max(word_ids)
    pairs = F.transform(word_ids, lambda w, i: F.struct(w.alias("word"), i.alias("piece")))
    of_word = lambda pairs, w: F.transform(F.filter(pairs, lambda p: p["word"] == w), lambda p: p["piece"])
    lists = let(pairs, body=lambda pairs: F.transform(F.sequence(F.lit(0), last), lambda w: of_word(pairs, w)))
    return F.when(last.isNotNull(), lists).otherwise(F.array().cast("array<array<int>>"))


def span_mean(hidden: Column, word_ids: Column, words: Column) -> Column:
    """Mean of the piece vectors that belong to the given words; null for no words."""
    def mean(words: Column) -> Column:
        hits = positions_where(word_ids, lambda w: F.array_contains(words, w))
        return F.when(F.size(words) > 0, mean_of(F.transform(hits, lambda i: as_double(F.get(hidden, i)))))

    return let(words, body=mean)
