from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventgrove.functions import tokens as tk
from eventgrove.operators.spans import drop_blank_tokens, split_compounds, strip_hyphen_suffix

SEPARATE = [
    ("a-b", ["a", "-", "b"]),
    ("-a", ["-a"]),
    ("a-", ["a", "-"]),
    ("a--b", ["a", "-", "", "-", "b"]),
    ("a/b-c", ["a", "/", "b", "-", "c"]),
    ("-", ["-"]),
    ("", []),
    ("a--", ["a", "-", "", "-"]),
    ("plain", ["plain"]),
]
ATTACH = [
    ("a-b", ["a-", "b"]),
    ("-a", ["-a"]),
    ("a-", ["a-", ""]),
    ("a--b", ["a-", "-", "b"]),
    ("a/b-c", ["a/", "b-", "c"]),
    ("-", ["-"]),
    ("", [""]),
]


@pytest.mark.parametrize("mode,cases", [("separate", SEPARATE), ("attach", ATTACH)])
def test_compound_cases(spark, mode, cases):
    rows = spark.createDataFrame([(i, [token]) for i, (token, _) in enumerate(cases)], "i int, tokens array<string>")
    got = {r["i"]: r["new_tokens"] for r in split_compounds(rows, mode).collect()}
    assert [got[i] for i in range(len(cases))] == [pieces for _, pieces in cases]


def test_compound_index_map(spark):
    rows = spark.createDataFrame([(["x", "", "a-b", "y"],)], "tokens array<string>")
    assert split_compounds(rows).first()["new_indices"] == [[0], [], [1, 2, 3], [4]]


def test_blank_tokens_shift_indices(spark):
    rows = spark.createDataFrame([(["The", "decision", "", "fell"], [1, 2, 3])], "tokens array<string>, indices array<int>")
    row = drop_blank_tokens(rows).first()
    assert (row["tokens"], row["indices"], row["text"]) == (["The", "decision", "fell"], [1, 2], "The decision fell")


def test_ones(one):
    assert one("n array<int>", [[0, 1, 0, 1]], tk.ones(F.col("n"))) == [1, 3]


def test_labels_to_pieces_and_back(one):
    tags = ["B-V", "B-ARG1", "I-ARG1", "O"]
    got = one("t array<string>, n array<int>", [tags, [1, 2, 2, 3]], tk.expand_labels(F.col("t"), F.col("n")))
    assert got == ["O", "B-V", "B-ARG1", "I-ARG1", "I-ARG1", "I-ARG1", "O", "O", "O", "O"]


def test_piece_offsets_stop_at_the_cap(one):
    got = one("n array<int>", [[2, 3, 4, 1]], tk.piece_offsets(F.col("n"), cap=6))
    # The third word does not fit; later, shorter ones do not come back.
    assert [(s["start"], s["end"]) for s in got] == [(1, 2), (3, 5)]


def test_sentence_spans_have_no_open_tail(one):
    got = one("t array<string>", [["a", ".", "b", "c", ".", "d"]], tk.sentence_spans(F.col("t")))
    assert [(s["start"], s["end"]) for s in got] == [(0, 2), (2, 5)]


def test_hyphen_suffix(one):
    label, parts = strip_hyphen_suffix(F.col("l"))
    assert one("l string", ["ARG1-H0-H1"], label) == "ARG1"
    assert one("l string", ["ARG1-H0-H1"], parts) == [0, 1]
    assert one("l string", ["ARG1-PRD"], parts) == []
