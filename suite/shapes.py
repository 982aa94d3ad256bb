"""Conversation turns in the layouts of the labelled event sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.operators.mentions import mention_column


def _with_mentions(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("mentions", mention_column(F.col("tokens")))


def ace_shape(corpus: DataFrame) -> DataFrame:
    mention = lambda m: F.struct(
        F.concat(F.lit("Event:"), m["kind"]).alias("event_type"), F.struct(m["token"].alias("text")).alias("trigger")
    )
    return _with_mentions(corpus).select("sentence", F.transform("mentions", mention).alias("event_mentions"))


def maven_shape(corpus: DataFrame) -> DataFrame:
    """One document per turn: its text twice as content, each mention an event in the second sentence."""
    event = lambda m: F.struct(
        m["kind"].alias("type"),
        F.array(F.struct(F.lit(1).alias("sent_id"), m["token"].alias("trigger_word"))).alias("mention"),
    )
    text = F.struct("sentence")
    return _with_mentions(corpus).select(F.array(text, text).alias("content"), F.transform("mentions", event).alias("events"))


def rams_shape(corpus: DataFrame) -> DataFrame:
    """One document per turn: a one-word first sentence, then the turn; triggers count from the document start."""
    trigger = lambda m: F.format_string(
        '[%d, %d, [["event.%s.n/a", 1.0]]]', m["tok_idx"] + 1, m["tok_idx"] + 1, m["kind"]
    )
    return _with_mentions(corpus).select(
        F.col("sent_id").alias("doc_key"),
        F.array(F.array(F.lit("First")), F.col("tokens")).alias("sentences"),
        F.transform("mentions", trigger).alias("evt_triggers"),
    )
