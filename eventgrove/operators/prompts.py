"""Demonstrations and in-context prompts. Lengths are in whitespace tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventgrove.functions.hashing import seeded_bits
from eventgrove.functions.let import unpacked
from eventgrove.functions.tokens import default_lemma, running_sum, token_form
from eventgrove.operators.hierarchies import split_label
from eventgrove.plans.ordering import POSITIONS_PER_PIECE, dense_index


def flatten_maven(df: DataFrame) -> DataFrame:
    """(sentence, event_type, trigger) per mention of each document, repeats in a sentence removed."""
    rows = df.select("content", F.explode("events").alias("event")).select(
        "content", F.col("event.type").alias("event_type"), F.explode("event.mention").alias("m")
    )
    return rows.select(
        F.get("content", F.col("m.sent_id"))["sentence"].alias("sentence"),
        "event_type",
        F.col("m.trigger_word").alias("trigger"),
    ).dropDuplicates()


def sentence_bounds(sentences: DataFrame) -> DataFrame:
    """Token range [start, end) of each sentence of a document given as ``sentences`` arrays."""
    lengths = F.transform("sentences", lambda s: F.size(s))
    rows = F.zip_with(
        F.col("sentences"), running_sum(lengths), lambda s, at: F.struct(s.alias("words"), at.alias("start"))
    )
    return sentences.select("doc_key", F.posexplode(rows).alias("sent_num", "_s")).select(
        "doc_key",
        "sent_num",
        F.col("_s.words").alias("words"),
        F.col("_s.start").alias("start"),
        (F.col("_s.start") + F.size("_s.words")).alias("end"),
    )


def locate_triggers(triggers: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Each trigger with the bounds [start, end) of its document that hold ``trigger_start``, and its ``local_index``.

    Bounds of a document do not overlap; empty ones hold nothing. Starts and triggers are sorted together,
    and the last start before a trigger is the only one that can hold it. The sort is one over all documents,
    cut into pieces, so a document with most of the rows is spread over many tasks, and the work grows with
    the rows of both sides, not with their pairs.
    """
    starts = bounds.where("start < end").select(key, F.col("start").cast("bigint").alias("_pos"), F.lit(0).alias("_kind"))
    points = triggers.where(F.col(key).isNotNull() & F.col("trigger_start").isNotNull())
    points = points.select(key, F.col("trigger_start").cast("bigint").alias("_pos"), F.lit(1).alias("_kind")).distinct()
    placed = dense_index(starts.unionByName(points), [F.col(key), F.col("_pos"), F.col("_kind")], "_at")
    cut = placed.withColumn("_piece", F.floor(F.col("_at") / POSITIONS_PER_PIECE)).withColumn("_opened", F.when(F.col("_kind") == 0, F.col("_pos")))
    inside = Window.partitionBy(key, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # Starts ascend, so the last one of the earlier pieces is the largest.
    carried = cut.groupBy(key, "_piece").agg(F.max("_opened").alias("_last")).select(key, "_piece", F.max("_last").over(earlier).alias("_carried"))
    held = cut.withColumn("_inside", F.max("_opened").over(inside)).where("_kind = 1").join(carried, [key, "_piece"])
    held = held.select(key, F.col("_pos").alias("trigger_start"), F.coalesce("_inside", "_carried").alias("start"))
    # What the bounds carry, such as words, moves once per bound and not once per trigger.
    found = triggers.join(held, [key, "trigger_start"]).join(bounds.where("start < end"), [key, "start"])
    columns = [key, "trigger_start", *(c for c in triggers.columns if c not in (key, "trigger_start")), "start"]
    rest = [c for c in bounds.columns if c not in (key, "start")]
    return (
        found.where(F.col("trigger_start") < F.col("end"))
        .select(*columns, *rest)
        .withColumn("local_index", F.col("trigger_start") - F.col("start"))
    )


def flatten_rams(df: DataFrame) -> DataFrame:
    """(sentence, event_type, trigger) with one row per trigger type, the trigger's first word as text.

    ``evt_triggers`` holds mixed arrays, kept as text: ``[start, end, [[type, score], ...]]``.
    """
    parsed = F.from_json(F.concat(F.lit('{"t":'), F.col("_t"), F.lit("}")), "t array<string>")["t"]
    triggers = df.select("doc_key", F.explode("evt_triggers").alias("_t")).select(
        "doc_key",
        F.get(parsed, F.lit(0)).cast("int").alias("trigger_start"),
        F.explode(F.from_json(F.get(parsed, F.lit(2)), "array<array<string>>")).alias("_type"),
    ).withColumn("event_type", F.get("_type", F.lit(0)))
    located = locate_triggers(triggers, sentence_bounds(df), "doc_key")
    return located.select(
        F.array_join("words", " ").alias("sentence"), "event_type", F.get("words", "local_index").alias("trigger")
    )


def flatten_ace(df: DataFrame) -> DataFrame:
    return df.select("sentence", F.explode("event_mentions").alias("m")).select(
        "sentence", F.col("m.event_type").alias("event_type"), F.col("m.trigger.text").alias("trigger")
    )


def demonstrations(events: DataFrame, dataset: str, edges: DataFrame | None = None, with_predicate: bool = True) -> DataFrame:
    """(input, output, predicate): sentence, last element of the type path, trigger."""
    paths = split_label(events, "event_type", dataset, edges)
    columns = [F.col("sentence").alias("input"), F.element_at("path", -1).alias("output")]
    if with_predicate:
        columns.append(F.col("trigger").alias("predicate"))
    return paths.select(*columns)


def prompt_rows(frames: DataFrame) -> DataFrame:
    """(target_id, input, predicate): joined words and the first lemma of each frame."""
    rows = unpacked(frames, ["sent_id", "words"], "frames", "frame", "_f")
    first = F.get("words", F.get("_f.indices", F.lit(0)))
    return rows.select(
        F.concat_ws("#", "sent_id", "frame").alias("target_id"),
        F.array_join("words", " ").alias("input"),
        default_lemma(token_form(first)).alias("predicate"),
    )


def sample_demonstrations(targets: DataFrame, demos: DataFrame, k: int, seed: int) -> DataFrame:
    """k demonstrations per target, with replacement: (target_id, draw, input, output, predicate).

    The draw is a hash of (seed, target, draw number), so it depends neither on partitions nor on order.
    """
    # The texts, many times longer than the rest, are numbered once each in their order and joined back at the end,
    # where the draws of a text stand together. They move once per text and not once per demonstration or draw.
    texts = dense_index(demos.select(F.col("input").alias("_text")).distinct(), [F.col("_text")], "_text_id")
    narrow = demos.join(texts, F.col("input").eqNullSafe(F.col("_text"))).drop("input", "_text")
    numbered = dense_index(narrow, [F.col("_text_id"), F.col("output"), F.col("predicate")], "_demo")
    n = numbered.count()
    draws = targets.select("target_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    chosen = draws.withColumn("_demo", seeded_bits(seed, F.col("target_id"), F.col("draw")) % n)
    return (
        chosen.join(numbered, "_demo")
        .join(texts, "_text_id")
        .select("target_id", "draw", *(F.col("_text").alias("input") if c == "input" else c for c in demos.columns))
    )


@dataclass(frozen=True)
class Template:
    # The prompt prefixes.
    input: str = " sentence: "
    predicate: str = " predicate: "
    output: str = " event type: "
    missing: str = "N/A"


@dataclass(frozen=True)
class Limits:
    per_example: int = 256
    whole: int = 1024


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def build_prompts(
    targets: DataFrame, sampled: DataFrame, template: Template = Template(), limits: Limits = Limits(), null_input: bool = False
) -> DataFrame:
    """(target_id, prompt, truncated): the drawn demonstrations in order, the target, the output prefix.

    Each example is cut to its limit, keeping the output; the prompt keeps its last ``limits.whole``
    tokens. ``null_input`` renders the target as ``N/A``.
    """

    def example(text: Column, predicate: Column, first: Column) -> Column:
        head = F.when(first, "").otherwise(template.input)
        return _tokens(F.concat(head, text, F.lit(template.predicate), predicate))

    output = _tokens(F.concat(F.lit(template.output), F.col("output")))
    room = F.greatest(F.lit(limits.per_example - 2) - F.size(output), F.lit(0))
    rendered = sampled.select(
        "target_id",
        "draw",
        F.concat(F.slice(example(F.col("input"), F.col("predicate"), F.col("draw") == 0), 1, room), output).alias("_demo"),
    )
    # At most k short arrays per target.
    context = rendered.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("draw", "_demo"))).alias("_demos"))
    missing = F.lit(template.missing)
    text = missing if null_input else F.col("input")
    predicate = missing if null_input else F.col("predicate")
    own = example(text, predicate, F.lit(False))
    own_room = limits.per_example - 2 - 1
    prefix = _tokens(F.lit(template.output))
    joined = F.concat(
        F.coalesce(F.flatten(F.transform("_demos", lambda d: d["_demo"])), F.array().cast("array<string>")),
        F.slice(F.col("_own"), 1, own_room),
    )
    keep = F.lit(limits.whole) - F.size(prefix)
    tail = F.slice(F.col("_joined"), F.greatest(F.size("_joined") - keep, F.lit(0)) + 1, F.greatest(keep, F.lit(0)))
    return (
        targets.join(context, "target_id", "left")
        .withColumn("_own", own)
        .withColumn("_joined", joined)
        .select(
            "target_id",
            F.array_join(F.concat(tail, prefix), " ").alias("prompt"),
            (F.size("_own") >= own_room).alias("truncated"),
        )
    )


def truncation_rate(prompts: DataFrame) -> DataFrame:
    return prompts.agg(F.avg(F.col("truncated").cast("double")).alias("truncation_rate"))
