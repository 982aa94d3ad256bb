"""BIO-tag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventgrove.functions.let import let
from eventgrove.functions.tokens import positions_where


def tag_label(tag: Column) -> Column:
    return F.substring(tag, 3, 1 << 30)


def _continues(tags: Column, i: Column) -> Column:
    """Tag i is an ``I-x`` that goes on with the span of tag i-1."""
    here, before = F.get(tags, i), F.get(tags, i - 1)
    return F.coalesce(here.startswith("I-") & (before != "O") & (tag_label(here) == tag_label(before)), F.lit(False))


def bio_to_spans(tags: Column) -> Column:
    """Maximal spans (label, start, end) with exclusive end; a span open at the sentence end is kept."""
    mark = lambda tags: F.transform(
        tags,
        lambda t, i: F.when(
            t != "O",
            F.struct(
                tag_label(t).alias("label"),
                i.alias("at"),
                (~_continues(tags, i)).alias("opens"),
                (~_continues(tags, i + 1)).alias("closes"),
            ),
        ),
    )
    # Every span opens once and closes once, so the two lists pair up.
    pair = lambda marked: F.zip_with(
        F.filter(marked, lambda m: m["opens"]),
        F.filter(marked, lambda m: m["closes"]),
        lambda o, c: F.struct(o["label"].alias("label"), o["at"].alias("start"), (c["at"] + 1).alias("end")),
    )
    return let(let(tags, body=mark), body=pair)


def spans_to_tags(spans: Column, n: Column) -> Column:
    """Paint non-overlapping (label, start, end) spans, exclusive end, on n ``O`` tags."""
    outside = F.lit("O")

    def piece(span: Column) -> Column:
        inside = F.array_repeat(F.concat(F.lit("I-"), span["label"]), span["end"] - span["start"] - 1)
        return F.concat(F.array(F.concat(F.lit("B-"), span["label"])), inside)

    def paint(spans: Column) -> Column:
        # The gap before each span, the span, and the gap after the last one.
        gap = lambda span, i: span["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        runs = F.transform(spans, lambda span, i: F.concat(F.array_repeat(outside, gap(span, i)), piece(span)))
        last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.flatten(runs), F.array_repeat(outside, n - last))

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))), body=paint)


def _open_text(pairs: Column) -> Column:
    # Every I- tag empties the pending bracket, so only the starts after the last I- survive.
    def render(pairs: Column, last_inside: Column) -> Column:
        pending = F.transform(
            F.filter(pairs, lambda p, i: p["tag"].startswith("B-") & (i > last_inside)),
            lambda p: F.concat(tag_label(p["tag"]), F.lit(": "), p["word"]),
        )
        outside = F.transform(F.filter(pairs, lambda p: p["tag"] == "O"), lambda p: p["word"])
        tail = F.when(
            F.size(pending) > 0, F.array(F.concat(F.lit("["), F.array_join(pending, " "), F.lit("]")))
        ).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(outside, tail), " ")

    last = F.coalesce(F.array_max(positions_where(pairs, lambda p: p["tag"].startswith("I-"))), F.lit(-1))
    return let(pairs, last, body=render)


def _bracket_text(pairs: Column) -> Column:
    def word(pairs: Column, p: Column, i: Column) -> Column:
        before, after = F.get(pairs, i - 1)["tag"], F.get(pairs, i + 1)["tag"]
        opening = (
            F.when(p["tag"].startswith("B-"), F.concat(F.lit("["), tag_label(p["tag"]), F.lit(": ")))
            .when(p["tag"].startswith("I-") & (F.coalesce(before, F.lit("O")) == "O"), "[")
            .otherwise("")
        )
        closing = F.when((p["tag"] != "O") & ~F.coalesce(after.startswith("I-"), F.lit(False)), "]").otherwise("")
        # Most words are outside and stay as they are.
        return F.when(p["tag"] == "O", p["word"]).otherwise(F.concat(opening, p["word"], closing))

    return let(pairs, body=lambda pairs: F.array_join(F.transform(pairs, lambda p, i: word(pairs, p, i)), " "))


def frame_text(words: Column, tags: Column, style: str = "bracket") -> Column:
    """``[ARG1: a b] [V: c] d``; ``open`` is the preposition form, which joins the starts into one final bracket."""
    pairs = F.zip_with(words, tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    if style == "open":
        return _open_text(pairs)
    if style == "bracket":
        return _bracket_text(pairs)
    raise ValueError(f"unknown style {style!r}")


def argument_positions(tags: Column, label: str) -> Column:
    """Positions whose tag ends with the label, so ``B-R-ARG1`` counts as ARG1."""
    return positions_where(tags, lambda t: t.endswith(label))


def bracket_tags(cells: Column) -> Column:
    """One column of ``(ARG0*`` / ``*`` / ``*)`` cells to BIO tags.

    A span runs to its closing cell, to the next opening one, or to the end of the sentence.
    """

    def spans(cells: Column, opens: Column, closes: Column) -> Column:
        n = F.size(cells)
        close = lambda at: F.coalesce(F.get(F.filter(closes, lambda c: c >= at), F.lit(0)) + 1, n)
        following = lambda k: F.coalesce(F.get(opens, k + 1), n)
        return F.transform(
            opens,
            lambda at, k: F.struct(
                F.regexp_replace(F.get(cells, at), r"^[()*]+|[()*]+$", "").alias("label"),
                at.alias("start"),
                F.least(close(at), following(k)).alias("end"),
            ),
        )

    def tags(cells: Column) -> Column:
        opens = positions_where(cells, lambda c: c.contains("("))
        closes = positions_where(cells, lambda c: c.contains(")"))
        return spans_to_tags(let(opens, closes, body=lambda opens, closes: spans(cells, opens, closes)), F.size(cells))

    return let(cells, body=tags)
