"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are the runs of 1 to ``max_n`` words of a document. The words are written once, each followed
by one separator, and scanned once for running CRCs; the CRC of any run of words then comes from two of
them (``prefix_crc``). The bucket counts of documents and target give a gain per bucket, a document's
weight is the sum of its gains, and Gumbel noise makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventgrove.llm.columns import sub_batches
from eventgrove.llm.prefix_crc import RunningCrc
from eventgrove.plans.ordering import dense_index
from eventgrove.plans.scratch import freeze

SEPARATOR = 0x20


@dataclass(frozen=True)
class ResamplePlan:
    """Parameters: longest run of words, buckets, fewest words of a drawn document, percent drawn, seed of the noise."""

    max_n: int = 1
    buckets: int = 10_000
    min_words: int = 20
    share: int = 10
    seed: int = 2024


def _byte_classes() -> np.ndarray:
    """What each byte becomes: lower case for A-Z, itself for 0-9, a-z and all bytes of other letters, else 0."""
    out = np.zeros(256, dtype=np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[first : last + 1] = np.arange(first, last + 1)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


CLASSES = _byte_classes()


def hashed_features(texts: Sequence[bytes | None], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, features per text, buckets of all features, text after text)."""
    sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    joined = CLASSES[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)]
    inside = joined != 0
    before = np.concatenate([[False], inside[:-1]])
    first, after = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    ends = np.cumsum(sizes + 1)
    owner = np.searchsorted(ends, first, side="right")
    # One separator after each word: the byte behind it stays, all others between words go.
    normal = np.where(inside, joined, SEPARATOR)[inside | before].astype(np.uint8)
    lengths = after - first
    ends_at = np.cumsum(lengths + 1) - 1
    starts_at = ends_at - lengths
    crc = RunningCrc(normal)
    found, owners = [], []
    for n in range(1, max_n + 1):
        runs = max(len(first) - n + 1, 0)
        same = owner[:runs] == owner[n - 1 : n - 1 + runs]
        found.append(crc.of(starts_at[:runs][same], ends_at[n - 1 : n - 1 + runs][same]) % np.uint32(buckets))
        owners.append(owner[:runs][same])
    all_owners, values = np.concatenate(owners), np.concatenate(found)
    if max_n > 1:
        values = values[np.argsort(all_owners, kind="stable")]
    n_words = np.bincount(owner, minlength=len(texts))[: len(texts)]
    return n_words, np.bincount(all_owners, minlength=len(texts))[: len(texts)], values


def _width(plan: ResamplePlan) -> np.dtype:
    return np.dtype("<u2") if plan.buckets <= 1 << 16 else np.dtype("<u4")


def featurise(rows: DataFrame, text: str, plan: ResamplePlan) -> DataFrame:
    """``rows`` without ``text``, with n_words and the buckets of all features as packed integers."""
    others = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*others, T.StructField("n_words", T.LongType()), T.StructField("packed", T.BinaryType())])
    width = _width(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text):
            n_words, n_features, values = hashed_features(batch.column(text).cast(pa.binary()).to_pylist(), plan.max_n, plan.buckets)
            offsets = np.concatenate([[0], np.cumsum(n_features)]).astype(np.int64) * width.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(n_words), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(width))])
            kept = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), packed.cast(pa.binary())], names=schema.names)

    return rows.select(*(f.name for f in others), text).mapInArrow(run, schema)


def bucket_counts(features: DataFrame, plan: ResamplePlan) -> np.ndarray:
    """Features in each bucket, over all rows. A task gives one row per bucket, the driver gets as many."""
    width = _width(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(plan.buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                held += np.bincount(np.frombuffer(packed.as_buffer(), dtype=width), minlength=plan.buckets)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held[used], pa.int64())], names=["bucket", "n"])

    counted = features.select("packed").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(plan.buckets, dtype=np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket, in doubles."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise_bits(seed: int, id: Column) -> Column:
    """First 32 bits of sha256(``seed:id``), a null id as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def gumbel(bits: int) -> int:
    return math.floor(-1000 * math.log(-math.log((bits + 0.5) / 4294967296)))


def resample(df: DataFrame, target: DataFrame, plan: ResamplePlan, id: str = "doc_id", text: str = "text", target_text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, with its place in the draw.

    Returned as structs, so that no name clashes: ``row`` (the kept columns) and ``draw`` (n_words,
    n_features, weight, score, rank; the rank is null for rows not drawn). Null and empty texts have no
    features and weight 0. Equal scores go by id, null ids last; rows with equal ids and scores are
    interchangeable. Rows with equal ids share their noise. Texts are scanned whole. An empty table gives
    an empty result, an empty target gives every bucket a count of 0.

    The features are scanned once and frozen as packed integers; counting and weighing read those. The
    driver gets one count per bucket. Ranks come from one range sort of all rows, so no key is hot.
    """
    kept = list(keep if keep is not None else df.columns)
    rows = df.select(F.struct(*kept).alias("row"), F.col(id).alias("id"), noise_bits(plan.seed, F.col(id)).alias("bits"), F.col(text).alias("text"))
    features = freeze(featurise(rows, "text", plan), "features")
    source = bucket_counts(features, plan)
    wanted = bucket_counts(featurise(target.select(F.col(target_text).alias("text")), "text", plan), plan)
    gains, width = bucket_gains(source, wanted), _width(plan)
    weighed = T.StructType([f for f in features.schema.fields if f.name not in ("packed", "bits")])
    for name in ("n_features", "weight", "score"):
        weighed = weighed.add(name, T.LongType())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "packed"):
            values = [np.frombuffer(p.as_buffer(), dtype=width) for p in batch.column("packed")]
            weights = [int(gains[v].sum()) for v in values]
            scores = [w + gumbel(b) for w, b in zip(weights, batch.column("bits").to_pylist())]
            stays = [batch.column(n) for n in weighed.names[:-3]]
            made = [pa.array(x, pa.int64()) for x in ([len(v) for v in values], weights, scores)]
            yield pa.RecordBatch.from_arrays([*stays, *made], names=weighed.names)

    scored = features.mapInArrow(weigh, weighed).withColumn("open", F.col("n_words") >= plan.min_words)
    placed = dense_index(scored, [F.col("open").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()], "position")
    drawn = placed.where("open").count() * plan.share // 100
    rank = F.when(F.col("open") & (F.col("position") < drawn), F.col("position") + 1)
    return placed.select("row", F.struct("n_words", "n_features", "weight", "score", rank.alias("rank")).alias("draw"))
