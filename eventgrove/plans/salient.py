"""The flagship query: salient events of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.operators.mentions import annotate_sentences, assemble_documents, dedupe_mentions, mentions_of
from eventgrove.operators.salience import lemma_weights, rank_in_document, top_percentile
from eventgrove.plans.scratch import freeze


def salient_mentions(corpus: DataFrame, p: float | None = 0.1) -> DataFrame:
    """Ranked, filtered and de-duplicated mentions.

    The text is read once: sentences shrink to their token count and mentions, which are frozen
    because offsets, term counts and ranks all start from them.
    """
    annotated = freeze(annotate_sentences(corpus), "annotated")
    n_docs = annotated.select(F.count_distinct("doc_id")).first()[0]
    # A rule mention is one token, so its list of indices need not travel with it.
    mentions = assemble_documents(annotated, mentions_of(annotated).drop("indices"))
    weights = lemma_weights(mentions, n_docs).select("doc_id", "lemma", "score")
    scored = mentions.join(weights, ["doc_id", "lemma"])
    top = top_percentile(rank_in_document(scored), p)
    return dedupe_mentions(top.withColumn("indices", F.array("tok_idx")))


def salient_events(corpus: DataFrame, p: float | None = 0.1) -> DataFrame:
    """Salient verb and nominal events per document, with the rank and score of each."""
    return salient_mentions(corpus, p).select(
        "doc_id", "sent_id", "doc_tok_idx", "kind", "token", "lemma", "score", "ranking", "total_pred"
    )


def salient_event_counts(events: DataFrame) -> DataFrame:
    """Salient verb and nominal events per document."""
    return events.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "verb").alias("verbs"),
        F.count_if(F.col("kind") == "nom").alias("noms"),
        F.count(F.lit(1)).alias("events"),
    )
