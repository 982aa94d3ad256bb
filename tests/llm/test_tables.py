"""Top-k search, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventgrove.llm import mixing, topk
from eventgrove.llm.langid import fold, learn_profiles, predict_language
from eventgrove.llm.mix_queries import PLAN, domain_of
from eventgrove.llm.mixing import MixPlan, mix_sources
from eventgrove.llm.topk import SortedLists, top_k
from tests.llm import brute

# -- top-k ----------------------------------------------------------------------------------------


def test_sorted_lists_stop_only_when_nothing_better_is_left():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, d, k = rng.integers(1, 200), rng.integers(1, 6), int(rng.integers(1, 7))
        vectors = rng.integers(-3, 4, (n, d))
        ids = rng.permutation(n) * 3
        lists = SortedLists(ids, vectors)
        for own in ids[:4]:
            query = rng.integers(-3, 4, d)
            want = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors) if i != own)[:k]
            got_ids, got = lists.top(query, int(own), k)
            assert [(-int(s), int(i)) for i, s in zip(got_ids, got)] == want


def test_reading_stops_early():
    vectors = np.zeros((100_000, 2), dtype=np.int64)
    vectors[:, 0] = np.arange(100_000)
    lists = SortedLists(np.arange(100_000), vectors)
    lists.scores_from = CountedRows(lists.scores_from)
    assert lists.top(np.array([1, 0]), -1, 3)[0].tolist() == [99_999, 99_998, 99_997]
    assert lists.scores_from.read < 1_000


@pytest.mark.parametrize("candidate,query,width", [(23, 26, 64), (26, 26, 4096), (31, 31, 64)])
def test_large_products_are_exact(candidate, query, width):
    rng = np.random.default_rng(candidate)
    vectors = (1 << candidate) - 1 - rng.integers(0, 3, (40, width))
    asked = (1 << query) - 1 - rng.integers(0, 3, width)
    ids, got = SortedLists(np.arange(40), vectors).top(asked, -1, 20)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(v, asked)), i) for i, v in enumerate(vectors))[:20]
    assert [(-int(s), int(i)) for s, i in zip(got, ids)] == want


def test_components_of_any_size(spark):
    rows = [(0, [1.0, 1.0]), (1, [3e5, 1.0]), (2, [1.0, 0.0]), (3, [-1e12, 0.5]), (4, [1e6, 1e6]), (5, [1e300, 0.0]), (6, [1.7e308, 0.0]), (7, [-0.001, 2.0**60])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(frame, F.col("vec_id") < 5, k=8).collect()}
    vectors = {i: [math.floor(256 * x) if abs(x) < 2**40 else int(256 * x) for x in v] for i, v in rows if i != 6}  # 256 * 1.7e308 is not finite
    last = (1 << 63) - 1
    for q in range(5):
        scores = {i: sum(a * b for a, b in zip(vectors[q], v)) for i, v in vectors.items() if i != q}
        want = sorted((-max(min(s, last), -last - 1), i) for i, s in scores.items())
        assert [got[q, k + 1] for k in range(len(want))] == [(i, -s) for s, i in want]
        assert (q, len(want) + 1) not in got


class CountedRows:
    def __init__(self, rows):
        self.rows, self.read = rows, 0

    def __getitem__(self, at):
        self.read += len(at)
        return self.rows[at]


@pytest.mark.parametrize("block", [7, 16_384])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", max(2, block // 3))
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) / 4 for _ in range(3)]) for i in range(60)]
    rows += [rows[5], (60, rows[5][1]), (61, [0.5, -0.25]), (62, []), (None, [1.0, 1.0, 1.0])]
    odd = [(63, None), (64, [1.0, None, 0.0]), (65, [math.nan, 0.0, 0.0]), (50, [math.inf, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id bigint, embedding array<float>, score int, id int")
    vectors = {i: [math.floor(256 * x) for x in v] + [0] * (3 - len(v)) for i, v in rows if i is not None}
    want = []
    for q in sorted(i for i in vectors if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in top_k(table, F.col("vec_id") % 10 == 0).collect()) == want
    assert top_k(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert top_k(table.where("vec_id = 0"), F.col("vec_id") % 10 == 0).count() == 0


# -- mixing ---------------------------------------------------------------------------------------


def shares(budget, children):
    """{name: amount} of a budget among (name, weight, capacity), by filling up step by step."""
    given = {n: 0 for n, _, _ in children}
    open_ = {n: (w, c) for n, w, c in children if w > 0 and c > 0}
    while open_:
        weights = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * weights <= budget * w]
        if not full:
            return given | {n: budget * w // weights for n, (w, _) in open_.items()}
        full = [min(full, key=lambda n: (open_[n][1] / open_[n][0], n))]
        for n in full:
            given[n] = open_[n][1]
            budget -= open_.pop(n)[1]
    return given


def mixed_copies(rows, plan, domain):
    """{doc: copies} of (doc, tokens, lang, source) rows, by plain loops."""
    tokens = defaultdict(int)
    for _, n, lang, source in rows:
        tokens[domain(source), lang, source] += n
    weight = lambda level, name: plan.weights.get(level, {}).get(name, 1)
    capacity = {k: n * plan.max_epochs if weight("source", k[2]) else 0 for k, n in tokens.items()}
    lang_cap, dom_cap = defaultdict(int), defaultdict(int)
    for (d, l, _), c in capacity.items():
        lang_cap[d, l] += c
    lang_cap = {k: c if weight("lang", k[1]) else 0 for k, c in lang_cap.items()}
    for (d, _), c in lang_cap.items():
        dom_cap[d] += c
    dom_cap = {k: c if weight("domain", k) else 0 for k, c in dom_cap.items()}
    target = min(sum(tokens.values()) * plan.share // 100, sum(dom_cap.values()))
    budget = {}
    for d, b in shares(target, [(d, weight("domain", d), c) for d, c in dom_cap.items()]).items():
        for l, b2 in shares(b, [(l, weight("lang", l), c) for (x, l), c in lang_cap.items() if x == d]).items():
            for s, b3 in shares(b2, [(s, weight("source", s), c) for (x, y, s), c in capacity.items() if (x, y) == (d, l)]).items():
                budget[d, l, s] = b3
    copies = {}
    for leaf, b in budget.items():
        mine = [(i, n) for i, n, l, s in rows if (domain(s), l, s) == leaf]
        whole, rest = divmod(b, tokens[leaf]) if tokens[leaf] else (0, 0)
        upto = 0
        for i, n in sorted(mine, key=lambda r: (hashlib.md5(f"{plan.seed}:{whole}:{r[0]}".encode()).hexdigest(), str(r[0]))):
            upto += n
            copies[i] = whole + (1 if rest and upto <= rest else 0)
    return copies, budget


@pytest.mark.parametrize("share,epochs", [(100, 3), (30, 1), (400, 2)])
def test_mix(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    rng = random.Random(share)
    rows = [(i, rng.randrange(0, 60), rng.choice(["en", "en", "fr", "de"]), rng.choice(["a", "b", "c", "zero"])) for i in range(300)]
    plan = MixPlan({"domain": {"x": 5, "y": 1}, "lang": {"en": 3, "fr": 20}, "source": {"zero": 0, "b": 4}}, share, epochs, 9)
    table = spark.createDataFrame([(i, "w " * n, l, s) for i, n, l, s in rows], "doc_id bigint, text string, lang string, source string")
    domain = F.when(F.col("source") == "a", "x").otherwise("y")
    out = mix_sources(table, plan, domain).select("row.doc_id", "mix.*").collect()
    copies, budget = mixed_copies(rows, plan, lambda s: "x" if s == "a" else "y")
    assert {r["doc_id"]: r["copies"] for r in out} == copies
    assert all(r["copies"] <= epochs for r in out)
    used = sum(r["n_tokens"] * r["copies"] for r in out)
    assert used <= sum(budget.values()) <= sum(n for _, n, _, _ in rows) * share // 100


def test_mix_odd_rows(documents, empty):
    out = mix_sources(documents, PLAN, domain_of(F.col("source")))
    assert out.count() == documents.count()
    assert set(out.select("row.*").columns) == set(documents.columns)
    assert {r["domain"] for r in out.select("mix.domain").collect()} == {"web", "books", "other"}
    assert mix_sources(empty, PLAN, domain_of(F.col("source"))).count() == 0


# -- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(8)
    syllables = {"en": ["th", "ing", "er", "and", "of"], "fr": ["que", "eau", "oi", "é", "la"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    passage = say("en", 90)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "fr"])
        text = say(lang, rng.randrange(3, 150))
        rows.append((i, text + ("\n" + passage if i % 9 == 0 else ""), lang, f"src{i % 4}"))
    rows += [(60, rows[3][1], "en", "src0"), (61, rows[4][1] + " more", "en", "src1"), (62, "12 34 !!", "en", "src0"), (63, None, "fr", None), (64, "", None, "src2")]
    table = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(stage(spark, held[-1], str(tmp_path)).cache())
    assert all(h.columns == docs.columns for h in held[:-1])
    tables = [{r["doc_id"]: r for r in h.collect()} for h in held[:4]]
    assert set(tables[0]) - set(tables[1]) == {62, 63, 64}
    before = sorted(tables[1].values(), key=lambda r: r["doc_id"])
    component, _ = brute.components([r["doc_id"] for r in before], [r["text"] for r in before])
    assert set(tables[2]) == {r["doc_id"] for r, c in zip(before, component) if r["doc_id"] == c} < set(tables[1])
    mine = sorted(tables[2].values(), key=lambda r: r["doc_id"])
    flags = brute.covered([r["text"].encode() for r in mine], corpus_pipeline.PASSAGE_BYTES)
    assert sum(map(any, flags)) > 3
    for r, gone in zip(mine, flags):
        kept = bytes(b for b, g in zip(r["text"].encode(), gone) if not g).decode("utf-8", "ignore")
        assert (tables[3][r["doc_id"]]["text"], tables[3][r["doc_id"]]["n_chars"]) == (kept, len(kept))
    cut = [(r["doc_id"], len(brute.words(r["text"])), r["lang"], r["source"]) for r in tables[3].values()]
    copies, _ = mixed_copies(cut, PLAN, lambda s: ("web", "books", "code")[int(s[3:]) % 3])
    assert Counter(r["doc_id"] for r in held[4].collect()) == Counter({i: n for i, n in copies.items() if n})
    processor = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.piece_model_path())
    for r in held[5].collect():
        assert r["ids"] == processor.encode(tables[3][r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])
    assert held[5].count() == held[4].count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    assert fold(F.col("doc_id")) is not None


def test_short_documents_keep_their_place(spark):
    rng = random.Random(9)
    syllables = {"en": ["th", "ing", "er", "and", "of"], "fr": ["que", "eau", "oi", "é", "la"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[l]) for _ in range(3)) for _ in range(60)), l) for i, l in enumerate(["en", "fr"] * 20)]
    short = [" ".join("".join(rng.choice("bjkmpvwxyz") for _ in range(4)) for _ in range(n)) for n in range(1, 9) for _ in range(5)] + ["OK", "to", "Public"]
    rows += [(100 + k, text, "en") for k, text in enumerate(short)] + [(200, "12 34 !!", "en"), (201, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = learn_profiles(docs.where(fold(F.col("doc_id")) != 1))
    scores = [r["score"] for r in predict_language(docs, profiles).where("doc_id >= 100 AND doc_id < 200").collect()]
    assert min(scores) < 0.05  # some are as far from every profile as noise is
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows} - {200, 201}


def test_near_copies_with_repeated_and_null_ids(spark):
    rng = random.Random(10)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(7, a), (7, a), (7, a + " end"), (None, b), (None, b), (3, c), (9, c + " end"), (9, d), (None, c), (None, e), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    out = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert [i for i, _ in out].count(7) == 1 and dict(t for t in out if t[0] == 7)[7].startswith(a)
    assert Counter(t for t in out if t[0] != 7) == Counter([(None, b), (3, c), (9, d), (None, e), (4, None), (4, None), (None, "")])


def test_passages_of_51_to_70_words_are_cut(spark):
    """Each planted passage stands in two documents; what surrounds it stays."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice(["th", "ing", "er", "a", "of", "que"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    passages = [say(n) for n in range(51, 71)]
    rows = [(2 * i + k, f"{say(60)}\n{p}\n{say(40)}", "en", "s", 0) for i, p in enumerate(passages) for k in (0, 1)] + [(100 + i, say(90), "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    for doc, text, *_ in rows:
        assert got[doc] == text if doc >= 100 else passages[doc // 2] not in got[doc] and got[doc].startswith(text[:200])


def test_pipeline_keeps_clashing_columns(spark):
    rows = [(i % 5, f"the house of words number {i} and the rest of it stands here for long", "en", "src0", 1, f"r{i}", f"l{i}", 0.5, "f", 3, "m") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _language string, _cosine double, _file string, row int, copies string")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_to_weights):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
