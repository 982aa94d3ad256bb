"""Span, tag and frame operators. All of them work inside the row of one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgrove.functions import tags as tg
from eventgrove.functions import tokens as tk
from eventgrove.functions.let import let, unpacked

_PIECES = "array<struct<start:int,end:int,label:string,prefix:string>>"
_PIECE = "struct<start:int,end:int,label:string,prefix:string>"


def split_compounds(df: DataFrame, mode: str = "separate", tokens: str = "tokens") -> DataFrame:
    """Adds ``new_tokens`` and ``new_indices`` (old position -> list of new positions)."""
    words = F.col(tokens)
    plain = ~F.exists(words, lambda t: t.contains("-") | t.contains("/") | (t == ""))
    counts = F.transform("_pieces", lambda p: F.size(p))
    # Most sentences have nothing to split.
    return (
        df.withColumn("_plain", plain)
        .withColumn("_pieces", F.when(~F.col("_plain"), F.transform(words, lambda t: tk.compound_pieces(t, mode))))
        .withColumn("new_tokens", F.when(F.col("_plain"), words).otherwise(F.flatten("_pieces")))
        .withColumn(
            "new_indices",
            F.when(F.col("_plain"), F.transform(words, lambda t, i: F.array(i))).otherwise(tk.index_lists(counts)),
        )
        .drop("_plain", "_pieces")
    )


def drop_blank_tokens(df: DataFrame, tokens: str = "tokens", indices: str = "indices") -> DataFrame:
    """Blank tokens removed, indices moved left, ``text`` = the kept tokens joined by spaces."""
    return (
        df.withColumn("_kept", tk.keep_tokens(F.col(tokens)))
        .withColumn(indices, tk.shift_indices(F.col(tokens), F.col(indices)))
        .withColumn(tokens, F.col("_kept"))
        .withColumn("text", F.array_join("_kept", " "))
        .drop("_kept")
    )


def parse_arguments(args: Column) -> Column:
    """``18_1:18_1*4:4-ARG0`` strings to (pieces, prefix, label); ``*`` is a chain (R-), ``,`` a split (C-)."""

    def endpoint(text: Column, side: str) -> tuple[Column, Column]:
        parts = F.split(text, "_")
        return (
            F.get(parts, F.lit(0)).try_cast("int").alias(side),
            F.get(parts, F.lit(1)).try_cast("int").alias(f"{side}_part"),
        )

    def piece(text: Column) -> Column:
        ends = F.split(text, ":")
        return F.struct(*endpoint(F.get(ends, F.lit(0)), "start"), *endpoint(F.get(ends, F.lit(1)), "end"))

    def parse(arg: Column) -> Column:
        where = F.regexp_extract(arg, r"^([^-]*)-", 1)
        return F.struct(
            F.transform(F.split(where, "[*,]"), piece).alias("pieces"),
            F.when(where.contains("*"), "R-").when(where.contains(","), "C-").otherwise("").alias("prefix"),
            F.regexp_extract(arg, r"^[^-]*-(.*)$", 1).alias("label"),
        )

    return F.transform(args, parse)


def place_arguments(arguments: Column, index_map: Column) -> Column:
    """Parsed arguments to flat pieces on the split tokens, sorted by start; the end is inclusive.

    A part number that the split token does not have makes the piece faulty, and it is left out.
    """

    return let(index_map, body=lambda index_map: _placed(arguments, index_map))


def _placed(arguments: Column, index_map: Column) -> Column:
    def locate(word: Column, part: Column, whole: Column) -> Column:
        places = F.get(index_map, word)
        return (
            F.when(part.isNull(), F.get(places, whole))
            .when(F.size(places) <= 1, F.get(places, F.lit(0)))
            .otherwise(F.get(places, part))
        )

    def pieces_of(arg: Column, nth: Column) -> Column:
        placed = F.transform(
            arg["pieces"],
            lambda p: F.struct(
                locate(p["start"], p["start_part"], F.lit(0)).alias("start"),
                locate(p["end"], p["end_part"], F.size(F.get(index_map, p["end"])) - 1).alias("end"),
            ),
        )
        sound = F.filter(placed, lambda p: p["start"].isNotNull() & p["end"].isNotNull())
        return F.transform(
            sound,
            lambda p, i: F.struct(
                p["start"].alias("start"),
                nth.alias("nth"),
                i.alias("piece"),
                p["end"].alias("end"),
                arg["label"].alias("label"),
                F.when(i > 0, arg["prefix"]).otherwise("").alias("prefix"),
            ),
        )

    ordered = F.array_sort(F.flatten(F.transform(arguments, pieces_of)))
    return F.transform(
        ordered,
        lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), p["prefix"].alias("prefix")),
    )


def _demotion(piece: Column) -> Column:
    """How easily a piece gives way to an overlapping one: 0 = plain core argument."""
    return (
        F.when(piece["prefix"] != "", 4)
        .when(piece["label"].contains("M"), 3)
        .when(F.upper(piece["label"]) == "SUPPORT", 2)
        .when(F.length(piece["label"]) > 4, 1)
        .otherwise(0)
    )


def _argument_number(piece: Column) -> Column:
    return F.coalesce(F.substring(piece["label"], 4, 8).try_cast("int"), F.lit(-1))


def resolve_overlaps(pieces: Column) -> Column:
    """Left-to-right fold over start-ordered pieces: of two overlapping ones the better stays."""
    nothing = F.lit(None).cast(_PIECE)
    start = F.struct(F.array().cast(_PIECES).alias("kept"), nothing.alias("open"))

    def step(acc: Column, cur: Column) -> Column:
        prev = acc["open"]
        overlaps = cur["start"] <= prev["end"]
        wins = F.when(
            (_demotion(cur) == 0) & (_demotion(prev) == 0), _argument_number(cur) > _argument_number(prev)
        ).otherwise(_demotion(prev) > _demotion(cur))
        return (
            F.when(prev.isNull(), F.struct(acc["kept"].alias("kept"), cur.alias("open")))
            .when(overlaps & wins, F.struct(acc["kept"].alias("kept"), cur.alias("open")))
            .when(overlaps, acc)
            .otherwise(F.struct(F.array_append(acc["kept"], prev).alias("kept"), cur.alias("open")))
        )

    finish = lambda acc: F.when(acc["open"].isNull(), acc["kept"]).otherwise(F.array_append(acc["kept"], acc["open"]))
    return F.aggregate(pieces, start, step, finish)


def _full_label(piece: Column) -> Column:
    return F.concat(piece["prefix"], piece["label"])


def _paint_over(pieces: Column, n: Column) -> Column:
    """Paint pieces one after the other; a piece inside one painted span, or hanging out of one, is skipped."""
    chained = lambda text: text.startswith("R-") | text.startswith("C-")

    def step(tags: Column, p: Column) -> Column:
        at_start, at_end = F.get(tags, p["start"]), F.get(tags, p["end"])
        inside = (at_end != "O") & (tg.tag_label(at_start) == tg.tag_label(at_end))
        hangs_out = (at_end == "O") & (
            ~chained(tg.tag_label(at_start)) | at_start.startswith("I-") | chained(p["label"])
        )
        painted = F.transform(
            tags,
            lambda t, i: F.when(i == p["start"], F.concat(F.lit("B-"), _full_label(p)))
            .when((i > p["start"]) & (i <= p["end"]), F.concat(F.lit("I-"), _full_label(p)))
            .otherwise(t),
        )
        return F.when((at_start != "O") & (inside | hangs_out), tags).otherwise(painted)

    return F.aggregate(pieces, F.array_repeat(F.lit("O"), n), step)


def spans_to_bio(arguments: Column, index_map: Column, n: Column, policy: str = "priority") -> Column:
    """BIO tags of one predicate; ``policy`` says which of two overlapping arguments is dropped."""
    placed = place_arguments(arguments, index_map)
    if policy == "dominated":
        return _paint_over(placed, n)
    if policy != "priority":
        raise ValueError(f"unknown policy {policy!r}")
    spans = F.transform(
        resolve_overlaps(placed),
        lambda p: F.struct(p["start"].alias("start"), (p["end"] + 1).alias("end"), _full_label(p).alias("label")),
    )
    return tg.spans_to_tags(spans, n)


def frame_spans(frames: DataFrame, *keys: str) -> DataFrame:
    """One row per span of each tagged row: keys, label, start, end (exclusive)."""
    return unpacked(frames, keys, tg.bio_to_spans(F.col("tags")), "_s").select(*keys, "_s.*")


def predicate_argument_graph(df: DataFrame) -> DataFrame:
    """Constituents and relations of each sentence's ``frames`` column.

    The predicate of a frame is a constituent that spans its indices; each span other than ``V``
    is an argument constituent, and a relation leads to it from the predicate.
    """

    def of_frame(frame: Column, nth: Column) -> Column:
        predicate = F.struct(
            nth.alias("frame"),
            F.lit(True).alias("is_predicate"),
            frame["text"].alias("label"),
            F.array_min(frame["indices"]).alias("start"),
            (F.array_max(frame["indices"]) + 1).alias("end"),
        )
        arguments = F.transform(
            F.filter(tg.bio_to_spans(frame["tags"]), lambda s: s["label"] != "V"),
            lambda s: F.struct(
                nth.alias("frame"),
                F.lit(False).alias("is_predicate"),
                s["label"].alias("label"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        )
        return F.concat(F.array(predicate), arguments)

    numbered = F.transform(
        F.flatten(F.transform("frames", of_frame)),
        lambda c, i: F.struct(
            i.alias("id"),
            c["frame"].alias("frame"),
            c["is_predicate"].alias("is_predicate"),
            c["label"].alias("label"),
            c["start"].alias("start"),
            c["end"].alias("end"),
        ),
    )

    def related(constituents: Column) -> Column:
        source_of = lambda c: F.get(
            F.filter(constituents, lambda p: p["is_predicate"] & (p["frame"] == c["frame"])), F.lit(0)
        )["id"]
        relations = F.transform(
            F.filter(constituents, lambda c: ~c["is_predicate"]),
            lambda c: F.struct(c["label"].alias("relation"), source_of(c).alias("src"), c["id"].alias("target")),
        )
        return F.struct(constituents.alias("constituents"), relations.alias("relations"))

    graph = df.withColumn("_graph", let(numbered, body=related))
    return graph.select("*", "_graph.constituents", "_graph.relations").drop("_graph")


def text_annotation(df: DataFrame, text: str = "sentence") -> DataFrame:
    """One nested record per sentence: text, tokens, offsets, sentence ends and the three views."""
    graph = predicate_argument_graph(df)
    tokens = F.col("tokens")
    return graph.select(
        "sent_id",
        F.struct(
            F.col(text).alias("text"),
            tokens.alias("tokens"),
            tk.token_offsets(F.array_join(tokens, " ")).alias("token_offsets"),
            F.transform(tk.sentence_spans(tokens), lambda s: s["end"]).alias("sentence_ends"),
            F.struct(
                tk.token_spans(tokens).alias("tokens"),
                tk.sentence_spans(tokens).alias("sentences"),
                F.col("constituents"),
                F.col("relations"),
            ).alias("views"),
        ).alias("annotation"),
    )


def align_event_labels(
    df: DataFrame, word_ids: str = "word_ids", events: str = "event_index", labels: str | None = "saliency", all_pieces: bool = False
) -> DataFrame:
    """Piece labels and type ids: an event's label on the first piece of its start word, -100 elsewhere.

    Without a label column each event counts as salient; the last of several events on one word wins.
    """
    count = F.size(F.col(events))
    given = F.col(labels) if labels else F.array_repeat(F.lit(1), count)
    pairs = F.zip_with(F.col(events), given, lambda e, s: F.struct(F.get(e, F.lit(0)).alias("word"), s.alias("label")))

    def label_of(ids: Column, pairs: Column, word: Column, i: Column) -> Column:
        first = (i == 0) | ~F.get(ids, i - 1).eqNullSafe(word)
        last_hit = F.try_element_at(F.filter(pairs, lambda p: p["word"] == word), F.lit(-1))["label"]
        shown = word.isNotNull() & (first | F.lit(all_pieces))
        return F.when(shown, F.coalesce(last_hit, F.lit(-100))).otherwise(-100)

    marked = let(
        F.col(word_ids), pairs, body=lambda ids, pairs: F.transform(ids, lambda w, i: label_of(ids, pairs, w, i))
    )
    return df.withColumn("labels", marked).withColumn(
        "type_ids", F.transform("labels", lambda x: F.when(x != -100, 1).otherwise(0))
    )


def candidate_predicates(df: DataFrame, pos_in: tuple[str, ...] = ("VERB",), prefix: str | None = None) -> DataFrame:
    """One row per token whose part of speech is in the set, or starts with ``prefix`` (gold ``NN``)."""
    rows = unpacked(df, ["sent_id"], F.arrays_zip("tokens", "pos"), "tok_idx", "_t")
    pos = F.col("_t.pos")
    wanted = pos.startswith(prefix) if prefix else pos.isin(*pos_in)
    return rows.where(wanted).select("sent_id", "tok_idx", F.col("_t.tokens").alias("token"), pos.alias("pos"))


def frames_with_sense(df: DataFrame) -> DataFrame:
    """Verb frames without a sense are left out."""
    return df.withColumn(
        "frames", F.filter("frames", lambda f: (f["kind"] != "verb") | (F.coalesce(f["sense"], F.lit("")) != ""))
    )


def multiword_groups(df: DataFrame, pos: str = "ADP", max_len: int = 3) -> DataFrame:
    """Runs of one part of speech, cut into groups of at most ``max_len`` tokens."""
    def groups(tags: Column) -> Column:
        places = tk.positions_where(tags, lambda t: t == pos)
        starts = lambda places: F.filter(places, lambda i: ~F.coalesce(F.get(tags, i - 1) == pos, F.lit(False)))
        return let(places, body=lambda places: let(starts(places), body=lambda runs: cut(places, runs)))

    def cut(places: Column, runs: Column) -> Column:
        run_of = lambda i: F.array_max(F.filter(runs, lambda s: s <= i))
        in_group = lambda head, j: (j >= head) & (j < head + max_len) & (run_of(j) == run_of(head))
        heads = F.filter(places, lambda i: (i - run_of(i)) % max_len == 0)
        return F.transform(heads, lambda h: F.filter(places, lambda j: in_group(h, j)))

    found = unpacked(df, ["sent_id", "tokens"], let(F.col("pos"), body=groups), "indices")
    return found.select(
        "sent_id", "indices", tk.collapse_to_words(F.col("tokens"), F.col("indices")).alias("_words")
    ).select("sent_id", "indices", F.array_join("_words", " ").alias("text"))


def drop_traces(leaves: Column, empty: str = "-NONE-") -> tuple[Column, Column]:
    """(words that stay, old position -> new position or -1) for an array of (word, pos) leaves."""
    kept = F.transform(leaves, lambda l: F.when(l["pos"] != empty, 1).otherwise(0))
    words = F.transform(F.filter(leaves, lambda l: l["pos"] != empty), lambda l: l["word"])
    return words, F.zip_with(tk.running_sum(kept), kept, lambda at, k: F.when(k == 1, at).otherwise(-1))


def strip_hyphen_suffix(label: Column) -> tuple[Column, Column]:
    """``ARG1-H0-H1`` -> (``ARG1``, [0, 1])."""
    parts = F.transform(F.regexp_extract_all(label, F.lit(r"-H(\d)"), F.lit(1)), lambda d: d.cast("int"))
    return F.regexp_replace(label, r"-H\d", ""), parts
