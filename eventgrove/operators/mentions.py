"""Event annotation and the mention table.

A mention row is ``doc_id, sent_id, sent_num, kind, tok_idx, indices, token, lemma``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventgrove import schemas
from eventgrove.functions import tags as tg
from eventgrove.functions import tokens as tk
from eventgrove.functions.let import let, unpacked
from eventgrove.plans.ordering import group_running_sum


def kind_priority(kind: Column) -> Column:
    """Verbs before nominals before prepositions."""
    return F.array_position(F.array(*[F.lit(k) for k in schemas.KINDS]), kind).cast("int")


def mention_column(tokens: Column) -> Column:
    """Rule-tagged tokens of a sentence as an array of structs, without an explode."""
    place = lambda token, i: F.struct(i.alias("tok_idx"), token.alias("token"), F.lower(token).alias("form"))
    form = lambda m: F.struct(m["tok_idx"].alias("tok_idx"), m["token"].alias("token"), tk.stripped_form(m["form"]).alias("form"))
    tag = lambda m: F.struct(
        tk.token_kind(m["form"]).alias("kind"), m["tok_idx"].alias("tok_idx"), m["token"].alias("token"), m["form"].alias("form")
    )
    lemma = lambda m: F.struct(
        m["kind"].alias("kind"), m["tok_idx"].alias("tok_idx"), m["token"].alias("token"), tk.default_lemma(m["form"]).alias("lemma")
    )
    # Each step reads the struct of the one before, so nothing is evaluated twice per token.
    tagged = F.transform(F.transform(F.transform(tokens, place), form), tag)
    return F.transform(F.filter(tagged, lambda m: m["kind"].isNotNull()), lemma)


def annotate_sentences(corpus: DataFrame) -> DataFrame:
    """One narrow row per sentence: keys, token count and rule-tagged mentions. No shuffle."""
    return corpus.select(
        "doc_id", "sent_id", "sent_num", F.size("tokens").alias("n_tokens"), mention_column(F.col("tokens")).alias("mentions")
    )


def mentions_of(annotated: DataFrame) -> DataFrame:
    return annotated.select("doc_id", "sent_id", "sent_num", F.inline("mentions")).withColumn(
        "indices", F.array("tok_idx")
    )


def _rule_frame(tokens: Column, m: Column) -> Column:
    """ARG0 = the token before the predicate, ARG1 = the two tokens after it, inside the sentence."""
    at, n = m["tok_idx"], F.size(tokens)
    spans = F.filter(
        F.array(
            F.struct(F.lit("ARG0").alias("label"), (at - 1).alias("start"), at.alias("end")),
            F.struct(F.lit("V").alias("label"), at.alias("start"), (at + 1).alias("end")),
            F.struct(F.lit("ARG1").alias("label"), (at + 1).alias("start"), F.least(at + 3, n).alias("end")),
        ),
        lambda s: (s["start"] >= 0) & (s["start"] < s["end"]),
    )
    return let(tg.spans_to_tags(spans, n), body=lambda tags: _tagged_frame(tokens, m, tags))


def _rule_text(tokens: Column, at: Column, tags: Column) -> Column:
    """``frame_text`` of a rule frame, whose spans lie within four tokens: the words around them need no look at a tag."""
    low = F.greatest(at - 1, F.lit(0))
    near = lambda items: F.slice(items, low + 1, at + 3 - low)
    text = tg.frame_text(near(tokens), near(tags))
    # An empty word at either end of the slice still is a word, and an empty array is none.
    before, after = F.slice(tokens, F.lit(1), low), F.slice(tokens, at + 4, F.size(tokens))
    return F.array_join(F.concat(before, F.array(text), after), " ")


def _tagged_frame(tokens: Column, m: Column, tags: Column) -> Column:
    at = m["tok_idx"]
    return F.struct(
        m["kind"].alias("kind"),
        m["token"].alias("text"),
        F.array(at).alias("indices"),
        F.array(at).alias("predicate_index"),
        F.when(m["kind"] == "verb", "1.0").otherwise("1").alias("sense"),
        _rule_text(tokens, at, tags).alias("description"),
        tags.alias("tags"),
    )


def annotate(corpus: DataFrame, annotator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Frames per sentence (``sent_id, words, frames``).

    Default: the suffix rule, in the JVM. An ``annotator`` gets batches of (sent_id, tokens) and
    yields batches of the frame table; load its model once per worker, before the first batch.
    """
    if annotator is not None:
        return corpus.select("sent_id", "tokens").mapInPandas(annotator, schemas.FRAMES)
    frames = lambda tokens: F.transform(mention_column(tokens), lambda m: _rule_frame(tokens, m))
    return corpus.select("sent_id", F.col("tokens").alias("words"), let(F.col("tokens"), body=frames).alias("frames"))


def mentions_from_frames(corpus: DataFrame, frames: DataFrame) -> DataFrame:
    """Mention rows of annotated sentences; the start token stands for the mention."""
    keys = corpus.select("doc_id", "sent_id", "sent_num")
    rows = unpacked(frames, ["sent_id", "words"], "frames", "_f").select("sent_id", "words", "_f.*")
    first = F.array_min("indices")
    return (
        rows.withColumn("tok_idx", first)
        .withColumn("token", F.get("words", first))
        .withColumn("lemma", tk.default_lemma(tk.token_form(F.col("token"))))
        .drop("words")
        .join(keys, "sent_id")
    )


def sentence_offsets(corpus: DataFrame) -> DataFrame:
    """Token offset of each sentence in its document."""
    lengths = corpus.select(
        "doc_id", "sent_id", "sent_num", (F.col("n_tokens") if "n_tokens" in corpus.columns else F.size("tokens")).alias("n_tokens")
    )
    return group_running_sum(lengths, ["doc_id"], "sent_num", F.col("n_tokens"), "sent_offset")


def assemble_documents(corpus: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions with ``doc_tok_idx``, their token position in the whole document."""
    offsets = sentence_offsets(corpus).select("sent_id", "sent_offset")
    return mentions.join(offsets, "sent_id").withColumn("doc_tok_idx", F.col("sent_offset") + F.col("tok_idx"))


def document_lengths(corpus: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per sentence: offset, tokens, verbs and nominals; 0 for a sentence without mentions."""
    counts = mentions.groupBy("sent_id").agg(
        F.count_if(F.col("kind") == "verb").alias("verbs_len"), F.count_if(F.col("kind") == "nom").alias("noms_len")
    )
    return sentence_offsets(corpus).join(counts, "sent_id", "left").fillna(0, ["verbs_len", "noms_len"])


def document_candidates(mentions: DataFrame) -> DataFrame:
    """Distinct (start, end) event spans per document, from nominals and verbs alike."""
    shift = F.col("sent_offset")
    return mentions.select(
        "doc_id",
        (shift + F.array_min("indices")).alias("start"),
        (shift + F.array_max("indices") + 1).alias("end"),
    ).distinct()


def dedupe_mentions(mentions: DataFrame) -> DataFrame:
    """One event per token: mentions go out per index, verbs win over nominals, then the earlier one wins."""
    per_token = mentions.withColumn("_first", F.array_min("indices")).withColumn("token_index", F.explode("indices"))
    order = Window.partitionBy("sent_id", "token_index").orderBy(kind_priority(F.col("kind")), "_first")
    return per_token.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_first")


def event_counts(mentions: DataFrame) -> DataFrame:
    """Events and sentences with events, per kind."""
    per_sentence = mentions.groupBy("kind", "sent_id").agg(F.count(F.lit(1)).alias("n"))
    return per_sentence.groupBy("kind").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("sentences")
    )


def join_lexicon(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Part of speech and lemma from (token, pos, lemma) by word form; the rule lemma where it has no entry."""
    entries = lexicon.select(
        F.col("token").alias("form"), F.col("pos"), F.col("lemma").alias("_lemma")
    )
    return (
        mentions.withColumn("form", tk.token_form(F.col("token")))
        .join(entries, "form", "left")
        .withColumn("lemma", F.coalesce("_lemma", tk.default_lemma(F.col("form"))))
        .drop("_lemma")
    )
