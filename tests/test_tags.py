from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventgrove.functions import tags as tg
from eventgrove.operators.mentions import dedupe_mentions
from eventgrove.operators.spans import align_event_labels, multiword_groups, parse_arguments, spans_to_bio


def bio(one, args, n=8, policy="priority", index_map=None):
    index_map = index_map or [[i] for i in range(n)]
    column = spans_to_bio(parse_arguments(F.col("a")), F.col("m"), F.lit(n), policy)
    return one("a array<string>, m array<array<int>>", [args, index_map], column)


OVERLAPS = [
    # (arguments, tags that stay): core beats a modifier, whichever comes first
    (["0:2-ARGM-TMP", "1:3-ARG1"], ["O", "B-ARG1", "I-ARG1", "I-ARG1", "O"]),
    (["0:2-ARG1", "1:3-ARGM-TMP"], ["B-ARG1", "I-ARG1", "I-ARG1", "O", "O"]),
    (["0:2-Support", "1:3-ARG1"], ["O", "B-ARG1", "I-ARG1", "I-ARG1", "O"]),
    (["0:2-ARG1", "1:3-Support"], ["B-ARG1", "I-ARG1", "I-ARG1", "O", "O"]),
    (["0:2-ARGM-TMP", "1:3-Support"], ["O", "B-Support", "I-Support", "I-Support", "O"]),
    (["0:2-ARG1-PRD", "1:3-ARG0"], ["O", "B-ARG0", "I-ARG0", "I-ARG0", "O"]),
    # the higher argument number replaces the lower one
    (["0:2-ARG1", "1:3-ARG2"], ["O", "B-ARG2", "I-ARG2", "I-ARG2", "O"]),
    (["0:2-ARG2", "1:3-ARG1"], ["B-ARG2", "I-ARG2", "I-ARG2", "O", "O"]),
]


@pytest.mark.parametrize("args,expected", OVERLAPS)
def test_overlap_priority(one, args, expected):
    assert bio(one, args, n=5) == expected


def test_chains_and_splits_mark_later_pieces(one):
    assert bio(one, ["0:0*2:3-ARG0"], n=4) == ["B-ARG0", "O", "B-R-ARG0", "I-R-ARG0"]
    assert bio(one, ["0:0,2:3-ARG0"], n=4) == ["B-ARG0", "O", "B-C-ARG0", "I-C-ARG0"]
    # a later piece gives way to a plain argument
    assert bio(one, ["0:0,1:3-ARG0", "3:3-ARG1"], n=4) == ["B-ARG0", "O", "O", "B-ARG1"]


def test_hyphen_parts(one):
    parts = [[0], [1, 2, 3], [4]]
    assert bio(one, ["1_2:1_2-rel", "1_0:1_0-ARG1"], n=5, index_map=parts) == ["O", "B-ARG1", "O", "B-rel", "O"]
    assert bio(one, ["1:1-rel"], n=5, index_map=parts) == ["O", "B-rel", "I-rel", "I-rel", "O"]
    # a part that does not exist drops the piece, a part of an unsplit word means the word
    assert bio(one, ["1_7:1_7-rel", "0_1:0_1-ARG0"], n=5, index_map=parts) == ["B-ARG0", "O", "O", "O", "O"]


def test_dominated_policy(one):
    assert bio(one, ["0:3-ARG1", "1:2-ARG2"], n=5, policy="dominated") == ["B-ARG1", "I-ARG1", "I-ARG1", "I-ARG1", "O"]
    # hanging out of a painted span: skipped
    assert bio(one, ["0:2-ARG1", "1:3-ARG2"], n=5, policy="dominated") == ["B-ARG1", "I-ARG1", "I-ARG1", "O", "O"]
    # both ends painted by different spans: painted over
    assert bio(one, ["0:0-ARG1", "0:1-ARG2", "1:1-ARG3"], n=3, policy="dominated") == ["B-ARG1", "B-ARG3", "O"]


def naive_spans(tags):
    spans, open_span = [], None
    for i, tag in enumerate([*tags, "O"]):
        if open_span and not (tag.startswith("I-") and tag[2:] == open_span[0]):
            spans.append((open_span[0], open_span[1], i))
            open_span = None
        if tag != "O" and open_span is None:
            open_span = (tag[2:], i)
    return spans


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["O", "B-A", "I-A", "B-B", "I-B"]), max_size=9), min_size=20, max_size=60))
def test_spans_of_any_tags(spark, sequences):
    rows = spark.createDataFrame(list(enumerate(sequences)), "i int, tags array<string>")
    for row in rows.select("i", tg.bio_to_spans(F.col("tags")).alias("s")).collect():
        assert [(s["label"], s["start"], s["end"]) for s in row["s"]] == naive_spans(sequences[row["i"]])


def test_frame_text(one):
    words, tags = ["a", "b", "ran", "c"], ["B-ARG0", "I-ARG0", "B-V", "O"]
    schema = "w array<string>, t array<string>"
    assert one(schema, [words, tags], tg.frame_text(F.col("w"), F.col("t"))) == "[ARG0: a b] [V: ran] c"
    assert one(schema, [words, tags], tg.frame_text(F.col("w"), F.col("t"), "open")) == "c [V: ran]"
    assert one(schema, [["a", "b"], ["O", "I-X"]], tg.frame_text(F.col("w"), F.col("t"))) == "a [b]"


def test_brackets(one):
    column = tg.bracket_tags(F.col("c"))
    assert one("c array<string>", [["(ARG0*", "*", "*)", "(V*)", "*"]], column) == ["B-ARG0", "I-ARG0", "I-ARG0", "B-V", "O"]
    # a span that is never closed runs to the next one, or to the end
    assert one("c array<string>", [["(A*", "*", "(B*", "*"]], column) == ["B-A", "I-A", "B-B", "I-B"]


def test_multiword_groups(spark):
    rows = spark.createDataFrame(
        [("s", list("abcdefg"), ["ADP"] * 4 + ["X", "ADP", "X"])], "sent_id string, tokens array<string>, pos array<string>"
    )
    assert sorted(r["text"] for r in multiword_groups(rows).collect()) == ["a b c", "d", "f"]


def test_align_event_labels(spark):
    schema = "word_ids array<int>, event_index array<array<int>>, saliency array<int>"
    rows = spark.createDataFrame([([None, 0, 1, 1, 2, None], [[1, 2], [2, 3]], [1, 0])], schema)
    row = align_event_labels(rows).first()
    assert row["labels"] == [-100, -100, 1, -100, 0, -100] and row["type_ids"] == [0, 0, 1, 0, 1, 0]
    assert align_event_labels(rows, all_pieces=True).first()["labels"] == [-100, -100, 1, 1, 0, -100]
    assert align_event_labels(rows, labels=None).first()["labels"] == [-100, -100, 1, -100, 1, -100]


def test_dedupe_prefers_verbs_then_the_earlier_nominal(spark):
    rows = spark.createDataFrame(
        [("s", "nom", [1, 2], "n1"), ("s", "nom", [2, 3], "n2"), ("s", "verb", [1], "v")],
        "sent_id string, kind string, indices array<int>, name string",
    )
    got = {r["token_index"]: r["name"] for r in dedupe_mentions(rows).collect()}
    assert got == {1: "v", 2: "n1", 3: "n2"}
