"""Scores of tagged output against gold data, and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventgrove.functions.hashing import BITS_RANGE, seeded_bits
from eventgrove.plans.ordering import dense_index


def _prf(hit: Column, predicted: Column, gold: Column) -> list[Column]:
    precision = F.when(predicted > 0, hit / predicted).otherwise(0.0)
    recall = F.when(gold > 0, hit / gold).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def span_prf(gold: DataFrame, pred: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ("V",)) -> DataFrame:
    """Precision, recall and F1 per label and overall (label null) of (keys, label, start, end) rows."""
    on = [*keys, "label", "start", "end"]
    kept = lambda df, name: df.where(~F.col("label").isin(*ignore)).select(*on, F.lit(1).alias(name))
    both = kept(gold, "_g").join(kept(pred, "_p"), on, "full")
    n = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    has_gold, has_pred = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    # Both groupings come from one map-side aggregate.
    counts = both.groupingSets([[F.col("label")], []], F.col("label")).agg(
        n(has_gold & has_pred).alias("correct"), n(has_pred).alias("predicted"), n(has_gold).alias("gold")
    )
    return counts.select("label", "correct", "predicted", "gold", *_prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def sense_accuracy(gold: DataFrame, pred: DataFrame, keys: Sequence[str], label: str = "sense") -> DataFrame:
    """Share of gold senses that were predicted; a missing prediction is wrong."""
    guessed = pred.select(*keys, F.col(label).alias("_pred"))
    right = F.col(label).eqNullSafe(F.col("_pred")).cast("double")
    return gold.select(*keys, label).join(guessed, list(keys), "left").agg(F.avg(right).alias("accuracy"))


def combined_score(f1: Column, accuracy: Column) -> Column:
    return f1 * accuracy


def binary_prf(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of class 1."""
    n = lambda test: F.sum(test.cast("bigint"))
    is_gold, is_pred = F.col(gold) == 1, F.col(pred) == 1
    counts = df.agg(n(is_gold & is_pred).alias("correct"), n(is_pred).alias("predicted"), n(is_gold).alias("gold"))
    return counts.select("correct", "predicted", "gold", *_prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def _may_follow(labels: Sequence[str]) -> np.ndarray:
    """allowed[i, j]: label j may come after label i. ``I-x`` needs ``B-x`` or ``I-x`` before it."""
    allowed = np.ones((len(labels), len(labels)), dtype=bool)
    for j, label in enumerate(labels):
        if label.startswith("I"):
            allowed[:, j] = [i == j or before == "B" + label[1:] for i, before in enumerate(labels)]
    return allowed


def best_sequences(probs: list[np.ndarray], labels: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(label numbers, score) of the best valid sequence of each matrix (positions x labels).

    All sequences take a step together, the longest first, so those that have ended leave at the back.
    Of equal ways the one over the first label counts.
    """
    allowed = np.where(_may_follow(labels), 0.0, -np.inf)
    may_start = np.where([label.startswith("I") for label in labels], -np.inf, 0.0)
    lengths = np.array([len(p) for p in probs])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    padded = np.zeros((len(probs), longest, len(labels)))
    for row, i in enumerate(order):
        padded[row, : lengths[i]] = probs[i]
    score = padded[:, 0] + may_start
    back = np.zeros(padded.shape, dtype=np.int32)
    ended = lengths[order]
    for at in range(1, longest):
        alive = int(np.searchsorted(-ended, -at, side="left"))
        reachable = score[:alive, :, None] + allowed
        back[:alive, at] = reachable.argmax(axis=1)
        score[:alive] = reachable.max(axis=1) + padded[:alive, at]
    paths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(probs)
    last = score.argmax(axis=1)
    held = np.zeros((len(probs), longest), dtype=np.int64)
    for at in range(longest - 1, -1, -1):
        alive = int(np.searchsorted(-ended, -at, side="left"))
        held[:alive, at] = last[:alive]
        last[:alive] = back[np.arange(alive), at, last[:alive]]
    for row, i in enumerate(order):
        paths[i] = held[row, : lengths[i]]
    scores = np.empty(len(probs))
    scores[order] = score.max(axis=1)
    return paths, scores


#: Numbers that one padded block of sequences holds, and numbers of the rows that a task turns into arrays at a time.
BLOCK_NUMBERS = 1 << 20
SLICE_NUMBERS = 1 << 19


def _slices(batch: pa.RecordBatch, column: str, width: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with about SLICE_NUMBERS numbers each, so memory does not grow with a batch's rows."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(lengths) - lengths) * width // SLICE_NUMBERS
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(lengths)]):
        yield batch.slice(int(start), int(end - start))


def decode_bio_arrays(sequences: DataFrame, labels: Sequence[str], probs: str = "probs") -> DataFrame:
    """``sequences`` with tags and score in place of ``probs``, an array of positions with an array of labels each.

    Row-local: sequences are decoded in padded blocks of an Arrow batch. An empty or null sequence has no
    tags and score 0.
    """
    names = np.array(list(labels), dtype=object)
    kept = [f for f in sequences.schema.fields if f.name != probs]
    schema = T.StructType([*kept, T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, probs, len(names))):
            values = [np.array(m or [], dtype=float).reshape(-1, len(names)) for m in batch.column(probs).to_pylist()]
            tags: list[list[str]] = [[]] * len(values)
            scores = np.zeros(len(values))
            todo = sorted((i for i, v in enumerate(values) if len(v)), key=lambda i: len(values[i]))
            while todo:
                size = max(1, BLOCK_NUMBERS // (len(values[todo[-1]]) * len(names)))
                block, todo = todo[-size:], todo[:-size]
                paths, best = best_sequences([values[i] for i in block], labels)
                scores[block] = best
                for i, path in zip(block, paths):
                    tags[i] = names[path].tolist()
            stays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*stays, pa.array(tags, pa.list_(pa.string())), pa.array(scores)], names=schema.names)

    return sequences.select(*(f.name for f in kept), probs).mapInArrow(decode, schema)


def decode_bio(probs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(seq_id, tags, score): the valid tag sequence with the largest sum of probabilities.

    ``probs``: seq_id, pos, probs. One group is one sentence, so its size does not grow with the data.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "probs")))
    sequences = probs.groupBy("seq_id").agg(F.transform(rows, lambda r: r["probs"]).alias("probs"))
    return decode_bio_arrays(sequences, labels)


def argmax_label(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """Most probable label per key; ties go to the label that sorts first."""
    best = F.min(F.struct((-F.col(prob)).alias("_p"), F.col(label).alias("_l"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *keys, F.col("_best._l").alias(label), (-F.col("_best._p")).alias(prob)
    )


# Corpus sections of the test and development splits.
TEST_SECTIONS = ("23",)
DEV_SECTIONS = ("00", "01", "22", "24")


def assign_split(file: Column) -> Column:
    """test, dev or train by the section digits of ``wsj/SS/wsj_SSNN.mrg``."""
    section = F.substring(file, 12, 2)
    return F.when(section.isin(*TEST_SECTIONS), "test").when(section.isin(*DEV_SECTIONS), "dev").otherwise("train")


def count_sentences(lines: DataFrame) -> DataFrame:
    """Distinct (file, sentnum) per split. Repeats go first, then counts combine map-side."""
    return lines.select("split", "file", "sentnum").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("sentences"))


def count_words_sentences(words: DataFrame) -> DataFrame:
    """Words per (split, genre) with totals; a word numbered 0 starts a sentence.

    Also counts the rows whose document id lacks the folder prefix of its split file.
    """
    rows = words.withColumn("_bad", ~F.col("doc_id").startswith(F.concat("genre", F.lit("/"))))
    return rows.rollup("split", "genre").agg(
        F.count(F.lit(1)).alias("words"),
        F.count_if(F.col("word_num") == 0).alias("sentences"),
        F.count_if("_bad").alias("foreign_ids"),
    )


def train_validation_split(
    df: DataFrame, key: str, fraction: float = 0.1, seed: int = 0, ordered: bool = False,
    max_train: int | None = None, max_validation: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, validation). By hash of the key; ``ordered`` takes the first share by key instead.

    The optional sizes keep the first rows by key of each side, as asked for by the caller.
    """
    if ordered:
        placed = dense_index(df, [F.col(key)], "_at")
        cut = int(placed.count() * fraction)
        validation, train = placed.where(F.col("_at") < cut).drop("_at"), placed.where(F.col("_at") >= cut).drop("_at")
    else:
        share = seeded_bits(seed, F.col(key)) / float(BITS_RANGE)
        validation, train = df.where(share < fraction), df.where(share >= fraction)
    if max_train is not None:
        train = train.orderBy(key).limit(max_train)
    if max_validation is not None:
        validation = validation.orderBy(key).limit(max_validation)
    return train, validation
