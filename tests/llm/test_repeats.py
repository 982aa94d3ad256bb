"""Repeated strings, repeated word windows and similar documents against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from eventgrove.llm import anchors
from eventgrove.llm.anchors import Symbols, key_columns
from eventgrove.llm.components import connected
from eventgrove.llm.fm_dedup import repeated_word_windows, search_by_index
from eventgrove.llm.jaccard import similar_documents
from eventgrove.llm.suffix_dedup import repeated_strings, search_by_buckets, strip_repeated_strings
from eventgrove.llm.trie import linked_pairs
from tests.llm import brute


@pytest.mark.parametrize("search,kind", [(search_by_buckets, "bytes"), (search_by_index, "words")])
def test_shard_search(search, kind):
    rng = random.Random(5)
    for _ in range(60):
        window = rng.choice([3, 5, 8, 9, 12, 17, 35, 40])
        base = bytes(rng.choice(b"ab") for _ in range(240))
        own = np.array([rng.randrange(1, 20) for _ in range(rng.randrange(1, 12))])
        data = []
        for n in own:
            start = rng.randrange(60)
            part = bytearray(base[start : start + n + window - 1])
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice(b"abc")
            data.append(bytes(part))
        copies = np.array([rng.choice([1, 1, 1, 2]) for _ in own])
        seen = Counter()
        for d, n, k in zip(data, own, copies):
            for i in range(n):
                seen[d[i : i + window]] += k
        want = [(f, i) for f, (d, n) in enumerate(zip(data, own)) for i in range(n) if seen[d[i : i + window]] > 1]
        stored = data if kind == "bytes" else [b" ".join(bytes([x]) for x in d) for d in data]
        found = search(stored, own, copies, Symbols(kind, window, 1))
        assert [(w, i) for w, a, b in zip(*found) for i in range(a, b)] == want


def test_runs_cover_every_window_once_and_depend_on_content_only():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    start, own, anchor, fragment = anchors.runs(text, np.array([0, 200, 205, 500]), 40, 8)
    covered = [s + k for s, n in zip(start, own) for k in range(n)]
    assert covered == [*range(0, 161), *range(205, 461)]
    again = anchors.runs(np.r_[text[205:500], text[0:200]], np.array([0, 295, 495]), 40, 8)
    assert sorted(zip(anchor, fragment)) == sorted(zip(again[2], again[3]))


def by_key(df, rows):
    """Collected rows with the keys that ``key_columns`` gives to (id, text)."""
    keys = df.select("doc_id", "text", *key_columns(df["doc_id"], df["text"])).collect()
    return [(r["doc_id"], r["text"], rows.get((r["k1"], r["k2"]))) for r in keys]


@pytest.mark.parametrize("limit", [1, 1 << 19])
def test_repeated_strings(documents, monkeypatch, limit):
    monkeypatch.setattr(anchors, "SHARD_BYTES", limit)
    found = {(r["k1"], r["k2"]): r for r in repeated_strings(documents, 60, 16).collect()}
    rows = by_key(documents, found)
    flags = brute.covered([(t or "").encode() for _, t, _ in rows], 60)
    assert any(map(any, flags)) and not all(map(any, flags))
    for (_, text, got), gone in zip(rows, flags):
        data = (text or "").encode()
        if any(gone):
            assert bytes(got["kept"]) == bytes(b for b, g in zip(data, gone) if not g)
            spans = [(a, b) for a, b in zip(got["starts"], got["ends"])]
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            assert spans == list(zip(edges[::2], edges[1::2]))
        else:
            assert got is None


def test_strip_keeps_rows_and_columns(documents):
    out = strip_repeated_strings(documents, 60, 16)
    assert out.columns == documents.columns
    flags = {}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for (i, t), gone in zip(rows, brute.covered([(t or "").encode() for _, t in rows], 60)):
        kept = bytes(b for b, g in zip((t or "").encode(), gone) if not g).decode("utf-8", "ignore")
        flags.setdefault(i, []).append(t if not any(gone) else kept)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    order = lambda xs: sorted(xs, key=lambda x: (x is None, x or ""))
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in flags.items()}


@pytest.mark.parametrize("limit", [1, 1 << 19])
def test_repeated_word_windows(documents, monkeypatch, limit):
    monkeypatch.setattr(anchors, "SHARD_BYTES", limit)
    found = {(r["k1"], r["k2"]): r for r in repeated_word_windows(documents, 12, 4).collect()}
    rows = by_key(documents, found)
    cut = [tuple(brute.words(t)) for _, t, _ in rows]
    for (_, _, got), w, gone in zip(rows, cut, brute.covered(cut, 12)):
        if any(gone):
            assert bytes(got["kept"]).decode() == " ".join(x for x, g in zip(w, gone) if not g)
        else:
            assert got is None


@pytest.mark.parametrize("slack", [0, 1, 2, 3, 5, 44, 336])
def test_classes_hold_every_window_once(slack):
    for own, place in ((slack + 1, slack), (1, 0), (1, slack), (slack // 2 + 1, slack // 2)):
        parts = list(anchors.window_classes(own, place, slack))
        assert sorted(w for first, end, _, _ in parts for w in range(first, end)) == list(range(own))
        for first, end, longer, left in parts:  # each of its windows holds the longer anchor
            assert left < max(1, slack) and all(0 <= longer - w <= left for w in range(first, end))


def test_one_passage_in_many_texts(spark, monkeypatch):
    """A passage that all texts share is cut by longer anchors until a shard holds what is left of it."""
    monkeypatch.setattr(anchors, "SHARD_BYTES", 4000)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, half = noise(150), noise(45)
    texts = [noise(rng.randrange(90)) + passage + noise(rng.randrange(90)) for _ in range(120)]
    texts += [noise(40) + rng.choice("xy") + half + passage[:70] + noise(30) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()
    found = {(r["k1"], r["k2"]): r for r in repeated_strings(df, 60, 16).collect()}
    rows = by_key(df, found)
    for (_, text, got), gone in zip(rows, brute.covered([t.encode() for _, t, _ in rows], 60)):
        assert bytes(got["kept"] if got else text.encode()) == bytes(b for b, g in zip(text.encode(), gone) if not g)
    found = {(r["k1"], r["k2"]): r for r in repeated_word_windows(df, 6, 2).collect()}
    rows = by_key(df, found)
    cut = [tuple(brute.words(t)) for _, t, _ in rows]
    for (_, _, got), w, gone in zip(rows, cut, brute.covered(cut, 6)):
        assert (bytes(got["kept"]).decode() if got else " ".join(w)) == " ".join(x for x, g in zip(w, gone) if not g)


def test_long_texts_are_hashed_in_parts(documents, monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 200)
    whole = Symbols("bytes", 60, 16)
    text = ("abc d" * 30 + "".join(map(str, range(400)))).encode()
    parts = list(anchors.pieces([text], whole))
    assert len(parts) > 3
    covered = sum(int(n) for codes, bounds, _, _ in parts for n in anchors.runs(codes, bounds, 60, 16)[1])
    assert covered == len(text) - 59


def test_empty_tables(empty):
    assert repeated_strings(empty, 60, 16).count() == 0
    assert repeated_word_windows(empty, 12, 4).count() == 0
    assert similar_documents(empty).count() == 0
    assert strip_repeated_strings(empty, 60, 16).count() == 0


def test_trie_pairs():
    rng = random.Random(3)
    for _ in range(120):
        base = [rng.sample(range(60), rng.randrange(1, 20)) for _ in range(3)]
        tokens, sizes, full, fresh = [], [], [], 1000
        for _ in range(rng.randrange(2, 25)):
            held = set(rng.choice(base))
            for _ in range(rng.randrange(4)):
                if rng.random() < 0.5 and len(held) > 1:
                    held.discard(rng.choice(sorted(held)))
                else:
                    held.add(rng.randrange(60))
            extra = rng.choice([0, 0, 1, 2])
            full.append(held | set(range(fresh, fresh + extra)))
            fresh += extra
            tokens.append(np.array(sorted(held)))
            sizes.append(len(full[-1]))
        n = len(tokens)
        group = np.array([rng.randrange(3) for _ in range(n)])
        component = np.array([rng.choice([i, i, rng.randrange(n)]) for i in range(n)])
        near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and component[i] != component[j] and near(full[i], full[j])}
        assert {tuple(sorted(p)) for p in linked_pairs(group, component, np.array(sizes), tokens, 80)} == want


def test_connected(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("block,cluster,unit", [(3, 2, 3), (3, 2, 1 << 14), (256, 1024, 1 << 14)])
def test_similar_documents(documents, monkeypatch, block, cluster, unit):
    for name, value in (("BLOCK", block), ("CLUSTER_SETS", cluster), ("UNIT_SETS", unit)):
        monkeypatch.setattr(f"eventgrove.llm.jaccard.{name}", value)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    component, size = brute.components([i for i, _ in rows], [t for _, t in rows])
    order = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((i, n, c) for (i, _), n, c in zip(rows, size, component)), key=order)
    got = sorted((tuple(r) for r in similar_documents(documents).collect()), key=order)
    assert got == want
    assert any(c != i for i, _, c in want)


def test_large_ids_beside_null_ids(spark):
    big = (1 << 62) + 1
    rows = [(big, "a b c d e f g"), (None, "a b c d e f g"), (big + 1, "x y"), (None, None)]
    found = similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in found), key=order) == sorted([(big, 3, big), (None, 3, big), (big + 1, 1, big + 1), (None, 0, None)], key=order)
