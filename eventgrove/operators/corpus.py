"""Corpus tables and their contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.functions.let import unpacked
from eventgrove.functions.tokens import whitespace_tokens


def corpus_from_table(df: DataFrame, doc: str, sent: str, text: str) -> DataFrame:
    """Typed sentences from any table with a document key, a sentence number and text."""
    return df.select(
        F.col(doc).cast("string").alias("doc_id"),
        F.concat_ws("-", F.col(doc), F.col(sent)).alias("sent_id"),
        F.col(sent).cast("int").alias("sent_num"),
        whitespace_tokens(F.col(text)).alias("tokens"),
        F.col(text).alias("sentence"),
    )


def corpus_from_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Sentences = the non-blank lines of a text column; numbers follow the line order."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.trim(line) != "")
    rows = unpacked(df.withColumn("_doc", F.col(doc)), ["_doc"], lines, "_sent", "_line")
    return corpus_from_table(rows, "_doc", "_sent", "_line")


def tokens_only(df: DataFrame) -> DataFrame:
    return df.select("tokens")


def validate_corpus(corpus: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Violations (check, doc_id, sent_id) instead of assertions; an empty table is a clean corpus."""
    rows = corpus.select("doc_id", "sent_id", "sent_num", "tokens")
    keys = rows.select("doc_id", "sent_num")
    first = rows.groupBy("doc_id").agg(F.min("sent_num").alias("_first"))
    followers = keys.select("doc_id", (F.col("sent_num") + 1).alias("sent_num")).distinct()

    def tagged(df: DataFrame, check: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "doc_id", "sent_id")

    found = [
        tagged(rows.where(~F.col("doc_id").rlike("^[0-9]+$")), "doc_id not numeric"),
        tagged(
            rows.join(followers, ["doc_id", "sent_num"], "left_anti")
            .join(first, "doc_id")
            .where(F.col("sent_num") > F.col("_first")),
            "previous sentence missing",
        ),
        tagged(
            rows.groupBy("sent_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1"),
            "sent_id repeated",
        ),
    ]
    if annotations is not None:
        words = annotations.select("sent_id", "words")
        found += [
            tagged(rows.join(words, "sent_id", "left_anti"), "sentence without annotation"),
            tagged(
                rows.join(words, "sent_id").where(~F.col("words").eqNullSafe(F.col("tokens"))), "words differ from tokens"
            ),
            tagged(
                words.join(rows, "sent_id", "left_anti").withColumn("doc_id", F.lit(None).cast("string")),
                "annotation without sentence",
            ),
        ]
    return reduce(DataFrame.unionByName, found)


def union_instances(**sources: DataFrame) -> DataFrame:
    """Annotated corpora stacked to (source, tokens, indicator, tags)."""
    parts = [
        df.select(F.lit(name).alias("source"), "tokens", "indicator", "tags") for name, df in sorted(sources.items())
    ]
    return reduce(DataFrame.unionByName, parts)
