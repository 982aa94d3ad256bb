"""Salience scores, ranks in the document and the top-percentile filter."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.plans.ordering import group_rank
from eventgrove.plans.scratch import freeze

SCORE_DIGITS = 9


def lemma_weights(mentions: DataFrame, n_docs: int) -> DataFrame:
    """tf, df and tf-idf score per (document, lemma); scores are rounded before anything ranks them."""
    tf = mentions.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n_docs)) + 1) / (F.col("df") + 1))
    return tf.join(df, "lemma").select(
        "doc_id", "lemma", "tf", "df", F.round(F.col("tf") * idf, SCORE_DIGITS).alias("score")
    )


def score_tfidf(mentions: DataFrame, n_docs: int) -> DataFrame:
    """One score per (document, start token)."""
    starts = mentions.select("doc_id", "doc_tok_idx", "lemma").distinct()
    return starts.join(lemma_weights(mentions, n_docs), ["doc_id", "lemma"]).select("doc_id", "doc_tok_idx", "score")


def salience_features(mentions: DataFrame, n_docs: int) -> DataFrame:
    """Inputs of the learned scorer: tf, idf, first position of the lemma and sentence number."""
    first = mentions.groupBy("doc_id", "lemma").agg(F.min("doc_tok_idx").alias("first_pos"))
    weights = lemma_weights(mentions, n_docs).join(first, ["doc_id", "lemma"])
    return (
        mentions.select("doc_id", "doc_tok_idx", "sent_num", "lemma")
        .dropDuplicates(["doc_id", "doc_tok_idx"])
        .join(weights, ["doc_id", "lemma"])
        .withColumn("idf", F.log((F.lit(float(n_docs)) + 1) / (F.col("df") + 1)))
    )


def score_learned(features: DataFrame, labels: DataFrame, rounds: int = 25) -> DataFrame:
    """Logistic regression on ``salience_features``, trained where ``labels`` (doc_id, doc_tok_idx, saliency) has a row."""
    features = freeze(features, "salience-features")  # read by the training and by the scoring
    columns = ["tf", "idf", "first_pos", "sent_num"]
    training = features.join(labels, ["doc_id", "doc_tok_idx"]).withColumn("label", F.col("saliency").cast("double"))
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="inputs"),
            LogisticRegression(featuresCol="inputs", labelCol="label", maxIter=rounds),
        ]
    ).fit(training)
    positive = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(features).select(
        "doc_id", "doc_tok_idx", F.round(positive, SCORE_DIGITS).alias("score")
    )


def scores_from_wire(wire: DataFrame) -> DataFrame:
    """Per-document score arrays to one row per scored event."""
    return wire.select("doc_id", F.inline(F.arrays_zip("event_start_idx", "pred", "saliency"))).select(
        "doc_id", F.col("event_start_idx").alias("doc_tok_idx"), F.col("pred").alias("score"), "saliency"
    )


def attach_scores(mentions: DataFrame, scores: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Scores by (document, start token); null where the scorer gave none. ``corpus`` limits the sentences."""
    rows = mentions if corpus is None else mentions.join(corpus.select("sent_id"), "sent_id", "left_semi")
    return rows.join(scores, ["doc_id", "doc_tok_idx"], "left")


def rank_in_document(scored: DataFrame, mode: str = "rank") -> DataFrame:
    """``ranking`` (0 = best) and ``total_pred`` for scored mentions; unscored ones are not ranked.

    ``compat`` instead gives the mention at position i the position of the i-th best one.
    """
    order = [F.col("score").desc(), F.col("doc_tok_idx"), F.col("kind")]
    ranked = group_rank(scored.where(F.col("score").isNotNull()), ["doc_id"], order, "ranking", "total_pred")
    if mode == "rank":
        return ranked
    if mode != "compat":
        raise ValueError(f"unknown mode {mode!r}")
    both = group_rank(ranked, ["doc_id"], [F.col("doc_tok_idx"), F.col("kind")], "_place", "_n").drop("_n")
    best = both.select("doc_id", F.col("ranking").alias("_place"), F.col("_place").alias("_best"))
    return both.drop("ranking").join(best, ["doc_id", "_place"]).withColumnRenamed("_best", "ranking").drop("_place")


def top_percentile(ranked: DataFrame, p: float | None = 0.1) -> DataFrame:
    """Mentions with ranking <= int(p * total), the bound included; ``None`` keeps all."""
    if p is None:
        return ranked
    return ranked.where(F.col("ranking") <= F.floor(F.lit(p) * F.col("total_pred")))
