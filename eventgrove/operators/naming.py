"""Names of tree nodes from token distributions, and the join back to the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventgrove import schemas
from eventgrove.functions.hashing import BITS_RANGE, seeded_bits
from eventgrove.operators.mentions import kind_priority
from eventgrove.operators.tree import leaves_of, path_fold

DISTRIBUTION = "node bigint, token string, prob double"


def token_distribution(mentions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(node, token, prob): relative frequency of the lemmas in each mention's sentence.

    ``mentions``: node, sent_id. ``lemmas``: sent_id, lemma, one row per token.
    """
    counts = lemmas.groupBy("sent_id", "lemma").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("sent_id").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "sent_id").select(
        "sent_id", F.col("lemma").alias("token"), (F.col("n") / F.col("total")).alias("prob")
    )
    return mentions.select("node", "sent_id").join(shares, "sent_id").select("node", "token", "prob")


def scored_distribution(prompts: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Distribution from a user's model, run over batches of the prompt table."""
    return prompts.mapInPandas(scorer, DISTRIBUTION)


def softmax(dist: DataFrame, vocabulary_size: int) -> DataFrame:
    """Softmax over the whole vocabulary; tokens without a row have probability 0, so weight 1 each.

    Each token's weight is divided by a per-node sum that is combined map-side.
    """
    weights = dist.withColumn("weight", F.exp("prob"))
    sums = weights.groupBy("node").agg(
        (F.sum("weight") + F.lit(vocabulary_size) - F.count(F.lit(1))).alias("whole")
    )
    return weights.join(sums, "node").select("node", "token", (F.col("weight") / F.col("whole")).alias("prob"))


def top_tokens(dist: DataFrame, k: int = 100, sampling: bool = False, seed: int = 0) -> DataFrame:
    """k tokens per node with their 0-based ``rank``: the most probable ones, or a weighted sample.

    The sample is without replacement: the k largest u^(1/p) with u a hash of (seed, node, token).
    The limit on the row number lets Spark keep k rows per node and task before the shuffle.
    """
    if sampling:
        uniform = (seeded_bits(seed, F.col("node"), F.col("token")) + 1) / F.lit(float(BITS_RANGE))
        key = F.log(uniform) / F.col("prob")
        dist = dist.where("prob > 0")
    else:
        key = F.col("prob")
    order = Window.partitionBy("node").orderBy(key.desc(), F.col("token"))
    ranked = dist.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return ranked.withColumn("rank", F.col("_n") - 1).drop("_n")


def name_nodes(top: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(node, name): lemma of the best noun or verb among the ranked tokens, else of the best token."""
    entries = lexicon.select("token", "pos", F.col("lemma").alias("_lemma"))
    tagged = top.join(entries, "token", "left").withColumn("lemma", F.coalesce("_lemma", "token"))
    not_usable = F.when(F.col("pos").isin("NOUN", "VERB"), 0).otherwise(1)
    return tagged.groupBy("node").agg(F.min_by("lemma", F.struct(not_usable, "rank")).alias("name"))


def path_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, names) per leaf: names strictly between root and leaf, top-down, first of repeats kept.

    Stretches of paths are put together without repeats, so a row holds the distinct names of its path.
    """
    leaves = leaves_of(edges).withColumn("_leaf", F.lit(True))
    nodes = edges.select(F.col("child").alias("node"), F.col("parent").alias("jump"))
    named = nodes.join(names.select("node", "name"), "node", "left").join(leaves, "node", "left")
    counts = F.col("name").isNotNull() & F.col("jump").isNotNull() & F.col("_leaf").isNull()
    start = named.select("node", "jump", F.when(counts, F.array("name")).otherwise(F.array().cast("array<string>")).alias("names"))
    folded = path_fold(start, {"names": lambda own, above: F.array_distinct(F.concat(above, own))}, "names")
    return folded.join(leaves.select("node"), "node", "left_semi")


def attach_event_types(corpus: DataFrame, named: DataFrame) -> DataFrame:
    """The corpus with ``predictions`` per sentence, empty where there is none.

    ``named``: sent_id, kind, indices, lemmas, names. Verbs come first, then by token.
    """
    predicate_text = F.array_join(
        F.transform("indices", lambda i: F.get("tokens", i)), " "
    )
    words = corpus.select("sent_id", "tokens")
    rows = named.join(words, "sent_id").select(
        "sent_id",
        F.struct(
            kind_priority(F.col("kind")).alias("kind"),
            F.array_min("indices").alias("at"),
            F.col("lemmas").alias("predicate_lemma"),
            F.col("indices").alias("predicate_index"),
            predicate_text.alias("predicate_text"),
            F.array_join("names", ":").alias("type_names"),
        ).alias("p"),
    )
    # A sentence holds at most one prediction per token.
    fields = ["predicate_lemma", "predicate_index", "predicate_text", "type_names"]
    ordered = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    predictions = rows.groupBy("sent_id").agg(ordered.alias("predictions"))
    empty = F.array().cast(f"array<{schemas.PREDICTION}>")
    return corpus.join(predictions, "sent_id", "left").withColumn("predictions", F.coalesce("predictions", empty))


def event_coverage(result: DataFrame) -> DataFrame:
    """Share of sentences with at least one prediction."""
    return result.agg(F.avg((F.size("predictions") > 0).cast("double")).alias("coverage"))
