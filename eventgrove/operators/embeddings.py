"""Vector operators on feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.functions import vectors as vec
from eventgrove.functions.let import unpacked
from eventgrove.functions.tags import argument_positions
from eventgrove.functions.tokens import default_lemma, token_form
from eventgrove.operators.mentions import kind_priority
from eventgrove.plans.ordering import dense_index


def masked_mean_by(df: DataFrame, keys: Sequence[str], vector: str, mask: str) -> DataFrame:
    """Mean vector per group over rows whose mask is 1, the count clamped at 1e-9.

    Sums are combined map-side, so a hot group costs no more than a small one.
    """
    weight = F.col(mask).cast("double")
    # Masked rows weigh nothing in the sum but still make their group appear.
    summed = df.groupBy(*keys).agg(
        Summarizer.sum(array_to_vector(vec.as_double(F.col(vector))), weight).alias("_sum"),
        F.sum(weight).alias("_kept"),
        F.max(F.size(vector)).alias("_width"),
    )
    total = F.when(F.col("_kept") > 0, vector_to_array("_sum")).otherwise(F.array_repeat(F.lit(0.0), F.col("_width")))
    clamped = F.greatest(F.col("_kept"), F.lit(1e-9))
    return summed.select(*keys, F.transform(total, lambda x: x / clamped).alias(vector))


def normalize_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, vec.l2_normalize(F.col(vector)))


def predicate_vectors(frames: DataFrame, hidden: DataFrame) -> DataFrame:
    """Predicate, ARG1 and ARG2 means of each frame's piece vectors; null where it has no such argument.

    ``frames``: sent_id, words, frames. ``hidden``: sent_id, word_ids, hidden.
    """
    rows = unpacked(frames, ["sent_id", "words"], "frames", "frame", "_f").join(hidden, "sent_id")
    lemmas = lambda places: F.transform(places, lambda i: default_lemma(token_form(F.get("words", i))))
    mean = lambda places: vec.span_mean(F.col("hidden"), F.col("word_ids"), places)
    arg1, arg2 = argument_positions(F.col("_f.tags"), "ARG1"), argument_positions(F.col("_f.tags"), "ARG2")
    return rows.select(
        "sent_id",
        "frame",
        F.col("_f.kind").alias("kind"),
        F.col("_f.sense").alias("sense"),
        lemmas(F.col("_f.indices")).alias("lemmas"),
        mean(F.col("_f.indices")).alias("predicate_emb"),
        mean(arg1).alias("arg1_emb"),
        lemmas(arg1).alias("arg1_lemma"),
        mean(arg2).alias("arg2_emb"),
        lemmas(arg2).alias("arg2_lemma"),
    )


def lookup_sense(mentions: DataFrame, senses: DataFrame) -> DataFrame:
    """The sense entry of each mention, null columns where none fits.

    Per lemma the key is the first of ``x_v``, ``x_n``, ``x`` that the inventory knows, whatever its
    senses; the first lemma whose key has the sense id wins. A verb sense such as ``1.0`` reads ``1``.
    ``mentions``: mention_id, kind, sense, lemmas. ``senses``: lemma_key, sense_id and values, unique per pair.
    """
    number = F.col("sense").try_cast("double")
    whole = F.abs(number - F.floor(number)) < 1e-10
    sense_id = F.when((F.col("kind") == "verb") & whole, number.cast("bigint").cast("string")).otherwise(F.col("sense"))
    candidates = mentions.select(
        "mention_id", sense_id.alias("sense_id"), F.posexplode("lemmas").alias("lemma_pos", "lemma")
    ).select(
        "mention_id",
        "sense_id",
        "lemma_pos",
        F.posexplode(
            F.array(F.concat("lemma", F.lit("_v")), F.concat("lemma", F.lit("_n")), F.col("lemma"))
        ).alias("_choice", "lemma_key"),
    )
    known = candidates.join(senses.select("lemma_key").distinct(), "lemma_key", "left_semi")
    chosen = known.groupBy("mention_id", "lemma_pos", "sense_id").agg(
        F.min_by("lemma_key", "_choice").alias("lemma_key")
    )
    values = [c for c in senses.columns if c not in ("lemma_key", "sense_id")]
    hits = chosen.join(senses, ["lemma_key", "sense_id"]).groupBy("mention_id").agg(
        F.min_by(F.struct("lemma_key", "sense_id", *values), "lemma_pos").alias("_hit")
    )
    return mentions.join(hits, "mention_id", "left").select(mentions["*"], "_hit.*")


def combine_vectors(df: DataFrame, columns: Sequence[str], how: str = "average", fallback: str | None = None, name: str = "features") -> DataFrame:
    """One vector from nullable sources: elementwise mean, or concatenation in source-name order."""
    ordered = [F.col(c) for c in sorted(columns)]
    sources = vec.present(*ordered)
    if how == "average":
        joined = vec.mean_of(sources)
    elif how == "concat":
        joined = F.when(F.size(sources) > 0, F.flatten(sources))
    else:
        raise ValueError(f"unknown combination {how!r}")
    if fallback:
        joined = F.coalesce(joined, vec.as_double(F.col(fallback)))
    checked = F.when(vec.has_nan(joined), F.raise_error(F.lit("NaN in a combined vector"))).otherwise(joined)
    return df.withColumn(name, checked)


def feature_table(verbs: DataFrame, nominals: DataFrame) -> DataFrame:
    """(id, kind, source_idx, features): verbs first, then nominals, ids dense from 0."""
    rows = verbs.select(F.lit("verb").alias("kind"), "source_idx", "features").unionByName(
        nominals.select(F.lit("nom").alias("kind"), "source_idx", "features")
    )
    return dense_index(rows, [kind_priority(F.col("kind")), F.col("source_idx")], "id")


@dataclass(frozen=True)
class Layer:
    """One encoder layer in inference form: linear, leaky ReLU and batch norm with fixed statistics."""

    weight: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    activate: bool = True

    # Slope of the leaky ReLU and epsilon of the batch norm.
    SLOPE = 0.01
    EPSILON = 1e-5

    def apply(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight.T + self.bias
        if not self.activate:
            return y
        y = np.where(y > 0, y, self.SLOPE * y)
        return (y - self.mean) / np.sqrt(self.variance + self.EPSILON) * self.scale + self.shift


def project_vectors(df: DataFrame, layers: Sequence[Layer], vector: str = "features") -> DataFrame:
    """Run the encoder over Arrow batches; the weights' size is set by the model, not by the data."""
    layers = list(layers)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(np.float64)
                for layer in layers:
                    x = layer.apply(x)
                batch[vector] = list(x)
                yield batch

    rows = df.withColumn(vector, vec.as_double(F.col(vector)))
    return rows.mapInPandas(encode, rows.schema)


def embedding_quality(pairs: DataFrame, triplets: DataFrame, margin: float = 1.0, weight: float = 0.01) -> DataFrame:
    """One row: mean squared reconstruction error, mean triplet margin and their weighted sum.

    ``pairs``: input, output. ``triplets``: anchor, positive, negative.
    """
    squared = vec.squared_norm(
        F.zip_with(vec.as_double(F.col("output")), vec.as_double(F.col("input")), lambda a, b: a - b)
    )
    reconstruction = pairs.agg((F.sum(squared) / F.sum(F.size("input"))).alias("reconstruction"))
    hinge = F.greatest(
        vec.distance(F.col("anchor"), F.col("positive")) - vec.distance(F.col("anchor"), F.col("negative")) + margin,
        F.lit(0.0),
    )
    similarity = triplets.agg(F.avg(hinge).alias("similarity"))
    # Both sides are one-row aggregates.
    return reconstruction.withColumn("similarity", similarity.scalar()).withColumn(
        "loss", F.col("reconstruction") + weight * F.col("similarity")
    )
