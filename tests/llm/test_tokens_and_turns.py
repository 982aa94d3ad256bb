"""Token files, conversation repair and target resampling against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventgrove.llm import byte_pieces, elias_fano
from eventgrove.llm.byte_pieces import BytePieces, load_tokenizer
from eventgrove.llm.conversations import conversation_digests, damage_conversations, repair_conversations
from eventgrove.llm.prefix_crc import RunningCrc
from eventgrove.llm.resample import ResamplePlan, hashed_features, resample
from eventgrove.llm.role_parser import RoleStacks
from eventgrove.llm.token_files import open_token_file, read_token_files, write_token_files
from tests.llm import brute

tokenizers = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


# -- token files ----------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, universe in [(0, 0), (1, 0), (1, 5), (5, 0), (1000, 10**6), (1000, 10), (5000, 2**40), (3, 2**64 - 1), (700, 2**63)]:
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64, endpoint=True))
        found = elias_fano.EliasFano(b"xyz" + elias_fano.encode(values, universe), 3)
        assert (found.all() == values).all()
        if n:
            some = rng.integers(0, n, 50)
            assert (found.get(some) == values[some]).all()
    sparse = np.sort(rng.integers(0, 300 * 100_000, 100_000, dtype=np.uint64))
    assert len(elias_fano.encode(sparse, 300 * 100_000)) * 8 / 100_000 < 2.3 + math.log2(300) + 1


@pytest.mark.parametrize("cut", [1 << 20, 37])
def test_byte_pieces_equal_the_library(monkeypatch, cut):
    monkeypatch.setattr(byte_pieces, "CUT_CHARS", cut)
    monkeypatch.setattr(byte_pieces, "HELD_CHARS", 600)
    rng = random.Random(3)
    alphabet = [*"abcAB  \n\t.'s,1 23éß漢🙂\x00\x1c\x85᠎​　\xa0", "  ", " a", "'s", " <|endoftext|> ", "<|endoftext|>", " the", ". "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", " ", "  ", "a " * 50]
    coder, plain = BytePieces(load_tokenizer(PATH)), library.Tokenizer.from_file(PATH)
    for start in range(0, len(texts), 400):
        part = texts[start : start + 400]
        ids, counts = coder.encode(part)
        assert ids.tolist() == [i for t in part for i in plain.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in part]


def test_other_tokenizers_take_whole_texts():
    path = tokenizers.path("word_bpe_49k.json")
    coder, plain = BytePieces(load_tokenizer(path)), library.Tokenizer.from_file(path)
    ids, _ = coder.encode(["A b  C", "", "x'y z"])
    assert not coder.by_word and ids.tolist() == [i for t in ["A b  C", "", "x'y z"] for i in plain.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("limit", [1 << 24, 64])
def test_token_files(spark, documents, tmp_path, limit):
    plain = library.Tokenizer.from_file(PATH)
    files = write_token_files(documents, str(tmp_path), load_tokenizer(PATH), 2, file_limit=limit)
    rows = read_token_files(files, str(tmp_path), with_ids=True).collect()
    order = sorted(rows, key=lambda r: r["start"])
    known = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in documents.collect())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order] == known
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    want = Counter((r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in documents.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    listed = files.collect()
    assert len(listed) >= (20 if limit == 64 else 1)
    one = open_token_file(str(tmp_path), listed[0]["file"])  # any document without reading the others
    last = np.array([one.n_docs - 1])
    assert one.ids(int(one.starts(last)[0]), one.n_ids)[-1] == 2


def test_token_files_of_nothing(spark, empty, tmp_path):
    files = write_token_files(empty, str(tmp_path), load_tokenizer(PATH), 2)
    assert files.count() == 0 and read_token_files(files, str(tmp_path)).count() == 0


# -- conversations --------------------------------------------------------------------------------


def cheapest(codes):
    """Shortest path over (row, end of the roles so far); codes as in ``role_parser``."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, end = heapq.heappop(heap)
        if (i, end) in done:
            continue
        done.add((i, end))
        if i == len(codes) and end in ("", "a"):
            return cost, audit
        for x in "ua":
            if (end, x) in follows:
                heapq.heappush(heap, (cost + 5, audit + "I", i, follows[end, x]))
        if i < len(codes):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, end))
            if codes[i] in "0123":
                continue
            extra = 5 if codes[i] in "SUA!" else 0
            for x in "sua":
                if (end, x) in follows and (x == codes[i].lower() or x != "s"):
                    same = x == codes[i].lower()
                    heapq.heappush(heap, (cost + extra + (not same), audit + ("K" if same else "R"), i + 1, follows[end, x]))


def repaired(rows):
    """Report and lines of one conversation's rows (turn, role, text)."""
    white = " \t\n\x0b\x0c\r"
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, codes, faults = set(), "", Counter()
    for _, role, text in rows:
        seen_text = text.rstrip(white)
        kind = "sua".find(role[:1]) if role[:1] else -1
        fault = "blank" if not seen_text else "duplicate" if (role, text) in seen else "truncated" if seen_text[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        codes += {"": "sua?", "truncated": "SUA!"}.get(fault, "0123")[kind]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(codes)
    out, i, roles = [], 0, ""
    for letter in audit:
        if letter != "D":
            role = rows[i][1] if letter == "K" else {"u": "user", "a": "assistant"}["a" if roles.endswith("u") else "u"]
            out.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
            roles += role[0]
        i += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", roles)
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit), "\n".join(out)


def odd_turns():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Yes. \t", "x" * 3000 + ".", "漢."]
    roles = ["user", "assistant", "system", "tool", "", None, "ubuntu"]
    rows = []
    for conv in [None, *range(40)]:
        weights = [8, 8, 1, 1, 1, 1, 1] if (conv or 0) % 2 else [1] * 7
        for n in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([n, n, n + 1, None, 2 * n]), rng.choices(roles, weights)[0], rng.choice(texts), "k", 1, "c"))
    # One conversation of many pieces, with its own repeats.
    rows += [(77, n, rng.choice(roles[:2]) if n % 5 == 0 else roles[n % 2], f"{rng.randrange(3000)} {rng.choice('.!?x')}", "k", 1, "c") for n in range(9000)]
    rows += [(99, 2**62, "user", "A.", "k", 1, "c"), (99, -(2**62), "assistant", "B.", "k", 1, "c")]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, place int, codes string"


def test_conversation_repair(spark):
    rows = odd_turns()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    repair = repair_conversations(frame)
    digests = {r["key"]: r["repaired_sha256"] for r in conversation_digests(repair.rows).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn, role, text))
    report = repair.report.collect()
    assert len(report) == len(groups)
    for r in report:
        want, lines = repaired(groups[r["conv_id"]])
        if r["conv_id"] == 99:  # a distance beyond a long is null
            want = (2**63 - 1 if 2**63 - 1 == want[0] else want[0], *want[1:])
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == want
        assert digests.get(r["key"], hashlib.sha256(b"").hexdigest()) == hashlib.sha256(lines.encode()).hexdigest()


def test_conversations_of_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    repair = repair_conversations(damage_conversations(frame))
    assert repair.report.count() == 0 and repair.rows.count() == 0 and conversation_digests(repair.rows).count() == 0


def test_damage(spark):
    rows = [r for r in odd_turns() if r[0] != 77]
    want = Counter()
    for conv, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        changed = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        want[changed] += {0: 0, 3: 2}.get(fate, 1)
    got = Counter(tuple(r) for r in damage_conversations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == +want


def test_parsing_in_pieces_equals_the_shortest_path():
    grammar, rng = RoleStacks(), random.Random(5)
    for n in range(1500):
        codes = "".join(rng.choice("suaauua?SUA!0123" if n % 2 else "suaua") for _ in range(rng.randrange(9)))
        whole = grammar.best(grammar.piece(codes, True))
        assert whole[1:] == cheapest(codes)
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(2))
        tables = [grammar.piece(p, i == 0) for i, p in enumerate((codes[: cuts[0]], codes[cuts[0] : cuts[1]], codes[cuts[1] :]))]
        assert grammar.best(grammar.combine([tables[0], grammar.combine(tables[1:])])) == whole
        way = grammar.tops_between(tables, 0, whole[0])
        assert "".join(t[a][b][1] for t, (a, b) in zip(tables, way)) == whole[2]


def test_grammar_without_bound_is_refused():
    with pytest.raises(ValueError, match="not bounded"):
        RoleStacks((("C", "uCa"), ("C", "")))


# -- resampling -----------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_n):
    words = WORD.findall((text or "").translate(brute.LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)], len(words)


def test_running_crc():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 5000, 800)
    end = np.minimum(5000, start + rng.integers(0, 3000, 800))
    got = RunningCrc(data).of(start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert RunningCrc(np.zeros(0, np.uint8)).of(np.array([0]), np.array([0])).tolist() == [0]


@pytest.mark.parametrize("max_n", [1, 3])
def test_hashed_features(max_n):
    texts = [t for _, t in brute.corpus()] + ["Az09 _éÉ~z", "\x7fa\x00b", None, "", "x" * 700]
    n_words, n_features, buckets = hashed_features([None if t is None else t.encode() for t in texts], max_n, 997)
    want = [features(t, max_n) for t in texts]
    assert n_words.tolist() == [n for _, n in want] and n_features.tolist() == [len(f) for f, _ in want]
    assert buckets.tolist() == [zlib.crc32(f.encode()) % 997 for fs, _ in want for f in fs]


def drawn(rows, target, plan):
    bucket = lambda f: zlib.crc32(f.encode()) % plan.buckets
    found = [features(t, plan.max_n) for _, t in rows]
    s = Counter(bucket(f) for fs, _ in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, plan.max_n)[0])
    total, wanted, b = sum(s.values()), sum(t.values()), plan.buckets
    out = []
    for (doc, _), (fs, n) in zip(rows, found):
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * (total + b) / ((s[k] + 1) * (wanted + b)))) for k in map(bucket, fs))
        h = int(hashlib.sha256(f"{plan.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= plan.min_words)
    taken = Counter(eligible[: len(eligible) * plan.share // 100])
    return Counter(out), taken


@pytest.mark.parametrize("plan", [ResamplePlan(share=30, min_words=3), ResamplePlan(max_n=2, buckets=70_000, share=50, min_words=0)])
def test_resample(spark, documents, plan):
    target = spark.createDataFrame([("the first of the words",), (None,), ("",), ("the of",)], "text string")
    got = resample(documents, target, plan).select("row.*", "draw").collect()
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want, taken = drawn(rows, [r["text"] for r in target.collect()], plan)
    assert Counter((r["doc_id"], *r["draw"][:4]) for r in got) == want
    chosen = sorted((r["draw"]["rank"], -r["draw"]["score"], r["doc_id"]) for r in got if r["draw"]["rank"] is not None)
    assert [c[0] for c in chosen] == list(range(1, len(chosen) + 1))
    assert Counter((c[1], c[2] is None, c[2] or 0) for c in chosen) == taken


def test_resample_nothing(spark, documents, empty):
    target = spark.createDataFrame([("the",)], "text string")
    assert resample(empty, target, ResamplePlan()).count() == 0
    none = resample(documents, target.limit(0), ResamplePlan(share=0))
    assert none.where("draw.rank is not null").count() == 0 and none.count() == documents.count()
