"""Token-array expressions; every one stays inside a row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventgrove.functions.let import let

# Suffix rule of the default annotator.
VERB_SUFFIXES = ("ed", "ing", "er")
NOMINAL_SUFFIXES = ("tion", "ment")
KNOWN_SUFFIXES = "^(.+?)(ed|ing|er|tion|ment)$"

_MARK = "\u0001"


def whitespace_tokens(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def stripped_form(lowered: Column) -> Column:
    """A lower-case token without trailing non-letters."""
    ends_in_letter = F.right(lowered, F.lit(1)).between("a", "z")
    return F.when(ends_in_letter, lowered).otherwise(F.regexp_replace(lowered, r"[^\p{L}]+$", ""))


def token_form(token: Column) -> Column:
    return stripped_form(F.lower(token))


def token_kind(form: Column) -> Column:
    """verb, nom or null by suffix."""
    ends_in = lambda suffixes: reduce(or_, [form.endswith(s) for s in suffixes])
    return F.when(ends_in(VERB_SUFFIXES), "verb").when(ends_in(NOMINAL_SUFFIXES), "nom")


def default_lemma(form: Column) -> Column:
    return F.regexp_replace(form, KNOWN_SUFFIXES, "$1")


def compound_pieces(token: Column, mode: str = "separate") -> Column:
    """Pieces of one token cut at ``-`` and ``/``.

    ``separate`` makes the delimiter a piece of its own, ``attach`` leaves it on the left piece. A
    token that starts with a delimiter stays whole.
    """
    if mode == "separate":
        cut = F.split(F.regexp_replace(token, "([-/])", f"{_MARK}$1{_MARK}"), _MARK)
        # A delimiter at the end leaves no empty piece behind it.
        pieces = let(cut, body=lambda cut: F.slice(cut, 1, F.size(cut) - (F.element_at(cut, -1) == "").cast("int")))
    elif mode == "attach":
        pieces = F.split(F.regexp_replace(token, "([-/])", f"$1{_MARK}"), _MARK)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    whole = token.startswith("-") | token.startswith("/")
    # Most tokens have no delimiter, and only the empty one differs between the modes.
    plain = ~token.contains("-") & ~token.contains("/") & (token != "")
    return F.when(whole | plain, F.array(token)).otherwise(pieces)


#: Entries that one fold of ``running_sum`` appends; every append copies what the fold holds.
SUM_PIECE = 24


def _folded_sum(counts: Column) -> Column:
    """(sums, at): the exclusive running sum by appending, and the total."""
    start = F.struct(F.array().cast("array<int>").alias("sums"), F.lit(0).alias("at"))
    step = lambda acc, n: F.struct(
        F.array_append(acc["sums"], acc["at"]).alias("sums"), (acc["at"] + n.cast("int")).alias("at")
    )
    return F.aggregate(counts, start, step)


def running_sum(counts: Column) -> Column:
    """Exclusive running sum of an int array (one element per entry).

    A long array is summed in pieces, and the pieces' totals once more, so that no long array is copied
    once per entry.
    """

    def joined(pieces: Column, bases: Column) -> Column:
        shifted = lambda piece, base: F.transform(piece["sums"], lambda at: at + base)
        return F.flatten(F.zip_with(pieces, bases, shifted))

    def in_pieces(counts: Column) -> Column:
        last = F.floor((F.size(counts) - 1) / SUM_PIECE).cast("int")
        cut = lambda k: F.slice(counts, k * SUM_PIECE + 1, F.lit(SUM_PIECE))
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: _folded_sum(cut(k)))
        totals = lambda pieces: _folded_sum(F.transform(pieces, lambda piece: piece["at"]))["sums"]
        return let(pieces, body=lambda pieces: let(totals(pieces), body=lambda bases: joined(pieces, bases)))

    return let(
        counts,
        body=lambda counts: F.when(F.size(counts) > SUM_PIECE, in_pieces(counts)).otherwise(_folded_sum(counts)["sums"]),
    )


def index_lists(counts: Column) -> Column:
    """For piece counts per token: the list of new positions of each old token."""
    none = F.array().cast("array<int>")
    return F.zip_with(
        running_sum(counts), counts, lambda at, n: F.when(n > 0, F.sequence(at, at + n - 1)).otherwise(none)
    )


def positions_where(items: Column, test) -> Column:
    """0-based positions of the items that pass ``test``."""
    return F.array_remove(F.transform(items, lambda x, i: F.when(test(x), i).otherwise(-1)), -1)


def ones(indicator: Column) -> Column:
    return positions_where(indicator, lambda x: x == 1)


def is_blank(token: Column) -> Column:
    return F.trim(token) == ""


def keep_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_blank(t))


def shift_indices(tokens: Column, indices: Column) -> Column:
    """Move indices left past the blank tokens; an index on a blank token goes away."""
    def move(tokens: Column) -> Column:
        kept = F.filter(indices, lambda i: ~is_blank(F.get(tokens, i)))
        return F.transform(kept, lambda i: F.size(keep_tokens(F.slice(tokens, 1, i + 1))) - 1)

    return let(tokens, body=move)


def token_offsets(text: Column) -> Column:
    """(form, start, end) of every token of text joined by single spaces."""
    forms = F.split(text, " ")
    starts = running_sum(F.transform(forms, lambda t: F.length(t) + 1))
    return F.zip_with(
        forms, starts, lambda t, s: F.struct(t.alias("form"), s.alias("start"), (s + F.length(t)).alias("end"))
    )


def sentence_spans(tokens: Column) -> Column:
    """[start, end) up to and including each ``.`` token; a tail without ``.`` has no span."""
    ends = F.transform(positions_where(tokens, lambda t: t == "."), lambda i: i + 1)
    return let(
        ends,
        body=lambda ends: F.transform(
            ends,
            lambda end, i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("start"), end.alias("end")),
        ),
    )


def token_spans(tokens: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t.alias("form"), i.alias("start"), (i + 1).alias("end")))


def expand_labels(labels: Column, n_pieces: Column) -> Column:
    """Word labels to piece labels; ``B-x`` goes on as ``I-x``, one ``O`` pads each end."""
    per_word = F.zip_with(
        labels,
        n_pieces,
        lambda tag, n: F.when(
            tag.startswith("B") & (n > 0),
            F.concat(F.array(tag), F.array_repeat(F.concat(F.lit("I"), F.substring(tag, 2, 1 << 30)), n - 1)),
        ).otherwise(F.array_repeat(tag, n)),
    )
    pad = F.array(F.lit("O"))
    return F.concat(pad, F.flatten(per_word), pad)


def expand_indicator(indicator: Column, n_pieces: Column) -> Column:
    per_word = F.zip_with(indicator, n_pieces, lambda bit, n: F.array_repeat(bit.cast("int"), n))
    pad = F.array(F.lit(0))
    return F.concat(pad, F.flatten(per_word), pad)


def piece_offsets(n_pieces: Column, cap: int = 510) -> Column:
    """(start, end) piece offsets of the words that fit ``cap`` pieces; position 0 is the start mark."""
    spans = F.zip_with(
        running_sum(n_pieces), n_pieces, lambda at, n: F.struct((at + 1).alias("start"), (at + n.cast("int")).alias("end"))
    )
    return F.filter(spans, lambda s: s["end"] <= cap)


def collapse_to_words(labels: Column, first_pieces: Column) -> Column:
    return let(labels, body=lambda labels: F.transform(first_pieces, lambda o: F.get(labels, o)))
