"""Operators that work row by row: pieces, pages, languages, quality rules, licences."""

from __future__ import annotations

import hashlib
import os
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest

from eventgrove.llm.extraction import extract_main_text, host_of
from eventgrove.llm.langid import Space, fold, learn_profiles, predict_language
from eventgrove.llm.licence_texts import LICENCES
from eventgrove.llm.licences import scan_licences
from eventgrove.llm.pages import Page
from eventgrove.llm.pieces import PieceCoder, decode_pieces, encode_pieces, load_model, round_trip_pieces
from eventgrove.llm.quality import quality_rules
from pyspark.sql import functions as F
from tests.llm import brute

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# -- pieces ---------------------------------------------------------------------------------------


def test_pieces_equal_the_library(processor):
    rng = random.Random(1)
    alphabet = [*"abcdefgh  ▁\n\téüß漢字🙂\x00<0x41>&", "the", "   ", "ing", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(600)]
    texts += ["".join(rng.choice("abcdeinrtsh") for _ in range(4000)), " " * 900, "a" * 700, "", None, " ", "▁", "<s> </s> <unk>"]
    coder = PieceCoder(load_model(MODEL))
    for _ in range(2):  # the second time from the cache
        flat, counts = coder.encode(texts)
        decoded = coder.decode(flat, counts)
        at = 0
        for text, n, back in zip(texts, counts, decoded):
            want = processor.encode(text or "")
            assert flat[at : at + n].tolist() == want
            assert back == processor.decode(want)
            at += n


def test_any_ids_decode_like_the_library(processor):
    rng = random.Random(2)
    lists = [[rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randrange(30))] for _ in range(400)]
    coder = PieceCoder(load_model(MODEL))
    texts = coder.decode(np.array([i for x in lists for i in x]), np.array([len(x) for x in lists]))
    assert texts == [processor.decode(x) for x in lists]


def test_pieces_on_tables(spark, documents, empty, processor):
    model = load_model(MODEL)
    coded = encode_pieces(documents, model)
    assert sorted(coded.columns) == sorted(documents.columns)  # the old column "ids" is replaced
    want = Counter((r["doc_id"], tuple(processor.encode(r["text"] or ""))) for r in documents.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == want
    both = round_trip_pieces(documents, model, keep=["doc_id", "text"]).collect()
    assert all(r["decoded"] == processor.decode(processor.encode(r["text"] or "")) for r in both)
    assert encode_pieces(empty, model).count() == 0 and round_trip_pieces(empty, model).count() == 0
    rows = spark.createDataFrame([(None,), ([],), ([5, None, 300],)], "ids array<int>")
    assert [r["decoded"] for r in decode_pieces(rows, model).collect()] == ["", "", processor.decode([5, 300])]


# -- pages ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav>
<div class="cookie-notice">We use cookies a lot and tell you at length, again and again and again.</div>
<div id="wrap"><div class="post-17 content"><article><header><h1>Head&amp;line</h1><span class=byline>By me</span></header>
<p>First <b>bold</b> and
 <i>more</i>&nbsp;text<br>next line.<p>Second, unclosed &lt;tag&gt; &#233;
<div class="ad-slot">Buy now</div><ul><li>one<li>two</ul><form><input name=q>Search</form>
<p hidden>secret</p><blockquote>Quoted</blockquote></article></div>
<aside>Aside text that is fairly long but not the article.</aside>
<section id="comments"><p>Great post, I have very much to say about it, longer than the article itself, as readers do.</p></section></div>
<footer>&copy; me</footer></body></html>"""


def test_page_blocks():
    page = Page(PAGE)
    path, size = page.best_container()
    assert path.endswith("/div.content.post-#/article") and size > 0
    want = ["Head&line", "First bold and more text next line.", "Second, unclosed <tag> é", "one", "two", "Quoted"]
    assert page.blocks(path) == want
    assert page.blocks(None) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<div><p>unclosed <b>x<br>y", ["unclosed x y"]),
        ("<nav>menu only</nav>", []),
        ("<p>2 < 3 and &bogus; &amp</p>", ["2 < 3 and &bogus; &"]),
        ("<body><p>a</p><!-- <p>no</p> --><p>b</p><script>x</script>", ["a", "b"]),
        ("<table><tr><td>1<td>2</table>", ["1", "2"]),
        ('<p title="a > b">x</p>', ["x"]),
        ("<p>x</p><script>never closed <p>y", ["x"]),
        ('<div class="has-sidebar no-comments"><p>x</p><div class="sidebarRight">y</div></div>', ["x"]),
        ('<div><div id="comment-7"><p>y</p></div><p>x</p></div>', ["x"]),
        ("</div></p>stray<p>z", ["stray", "z"]),
    ],
)
def test_odd_pages(html, want):
    assert Page(html).blocks(None) == want


def test_consensus_beats_one_page(spark):
    normal = "<body><div class=menu>m</div><div class='main'><p>Text %d of the host, long enough to count.</p></div><div class='extra'>%s</div></body>"
    rows = [(k, "http://www.h.org/%d" % k, normal % (k, "x"), "old", 1) for k in range(8)]
    rows += [(8, "https://h.org/8", normal % (8, "An unmarked box whose text is far longer than the article. " * 9), "old", 1)]
    rows += [(9, "http://h.org/9", None, "old", 1), (10, None, "<p>No host</p>", "old", 1), (11, "odd url", "", None, 1), (0, "http://www.h.org/0", rows[0][2], "old", 1)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string, host int")
    out = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    assert out[8] == "Text 8 of the host, long enough to count."
    assert out[9] == "" and out[11] == "" and out[10] == "No host"
    assert extract_main_text(pages).columns == ["page_id", "url", "html", "host", "text"] and extract_main_text(pages).count() == len(rows)
    assert extract_main_text(pages.limit(0)).count() == 0
    hosts = spark.createDataFrame([("HTTPS://u:p@WWW.A.b:80/x",), (None,), ("x",)], "url string").select(host_of(F.col("url")).alias("h"))
    assert [r["h"] for r in hosts.collect()] == ["a.b", "", ""]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<body><article><h1>T</h1><div class=intro>Intro.</div><div class=body><p>%s</p></div></article></body>", ["T", "Intro.", "L"]),
        ("<body><article><h1>T</h1><section><p>%s</p></section><section><p>Short.</p></section></article></body>", ["T", "L", "Short."]),
        ("<body><div class=post><h1>T</h1><div class=lead><p>Lead.</p></div><div class=body><p>%s</p></div></div></body>", ["T", "Lead.", "L"]),
        ("<body><div class=post><h1>T</h1><article><p>%s</p></article></div><p>Below.</p></body>", ["T", "L"]),
        ("<body><div class=list><a href=a>One link</a> <a href=b>Two</a></div><div class=body><p>%s</p></div><div>x</div></body>", ["L"]),
    ],
)
def test_containers_keep_the_whole_article(spark, html, want):
    long = "A long sentence of the article. " * 20
    page = Page(html % long)
    want = [long.strip() if w == "L" else w for w in want]
    assert page.blocks(page.best_container()[0]) == want
    rows = [(k, "http://h.org/", html % long) for k in range(3)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert {r["text"] for r in out} == {"\n\n".join(want)}


@pytest.mark.parametrize(
    "part",
    [
        "<h2 id='how-to-search'>%s</h2>",
        "<p class='notice-of-change'>%s</p>",
        "<table><tr><td class='form'>%s</td></tr></table>",
        "<table><tr><th class='header'>%s</th></tr></table>",
        "<p>See <span class='share'>%s</span></p>",
        "<ul><li id='related'>%s</li></ul>",
        "<section id='discussion'><p>%s</p></section>",
        "<div class='how-to-search-well'>%s</div>",
        "<div class='notice'><p>%s</p></div>",
    ],
)
def test_named_parts_of_an_article_stay(part):
    text = "What the part says in words. " * 9
    assert text.strip() in "\n".join(Page(f"<body><article><p>First.</p>{part % text}</article></body>").blocks(None))


def test_named_boilerplate_goes():
    links = "<a href=x>A link to another page of the site</a> " * 9
    named = ["<div class='cookie-notice'>%s</div>", "<div id=comments>%s</div>", "<ul class='nav'><li>%s</ul>", "<div class='sidebarRight'>%s</div>", "<div role=navigation>%s</div>"]
    pages = [n % ("Words that go on for a while. " * 9) for n in named]
    pages += [f"<div class='related-posts'>{links}</div>", f"<div class='share'>{links}</div>", "<div class='ad-slot'>Buy</div>", "<div class=byline>By me</div>", "<section id=search>Find</section>"]
    for boilerplate in pages:
        assert Page(f"<body><article><p>First.</p>{boilerplate}<p>Last.</p></article></body>").blocks(None) == ["First.", "Last."], boilerplate


LONG = "A long sentence of the article. " * 20


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><header><h1>T</h1><p class=lead>What it is about.</p><p class=byline>By A. Writer.</p><p>3 May 2020</p></header><p>%s</p></article>", ["T", "What it is about.", "L"]),
        ("<div class=wrap><div class=text>%s</div><div class=end>Closing remark</div></div>", ["L", "Closing remark"]),
        ("<article><p>%s</p><p>So <math><mi>x</mi><annotation>x</annotation></math> is <label>large</label>.</p></article>", ["L", "So x is large."]),
        ("<div><label>Name</label><input></div><article><p>%s</p></article>", ["L"]),
        ("<main><article><p>%s</p></article><article class=comment><p>First!</p></article><ol><li class='comment depth-1'>Second!</li></ol></main>", ["L"]),
        ("<main><article class=comment><p>%s</p></article></main>", ["L"]),
        ("<article><p>%s</p><p class=advert>Buy now</p><p>End.</p></article>", ["L", "End."]),
        ("<div>Home News Sport</div><div>%s</div><div>Copyright 2020 Us</div>", ["L"]),
        ("<div id=all><div><a href=x>Home</a></div><div>%s</div><div>© Us</div></div>", ["L"]),
        ("<article><p>%s</p><p>Copyright is a right.</p></article>", ["L", "Copyright is a right."]),
    ],
)
def test_parts_at_the_edge_of_an_article(spark, html, want):
    page = Page(f"<html><body>{html % LONG}</body></html>")
    path = page.best_container()[0]
    assert page.blocks(path, page.container) == [LONG.strip() if w == "L" else w for w in want]


def test_rare_template_with_a_winning_box(spark):
    usual = "<body><div class=top><p>%s</p></div></body>"
    nested = "<body><div class=wrap><h1>T</h1><p>%s</p><div class=top><p>Teaser.</p></div></div></body>"
    long = "A long sentence of the article. " * 20
    rows = [(k, "http://h.org/%d" % k, usual % long) for k in range(20)] + [(20, "http://h.org/20", nested % long)]
    rows += [(30 + k, "http://g.org/%d" % k, "<body><div class=wrap>" + usual[6:-7] % long + "</div></body>") for k in range(20)] + [(50, "http://g.org/x", nested % long)]
    out = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out[0] == out[30] == long.strip()
    assert out[20] == out[50] == "T\n\n" + long.strip() + "\n\nTeaser."


# -- languages ------------------------------------------------------------------------------------


def test_languages(spark, documents, empty):
    rng = random.Random(4)
    syllables = {"en": ["th", "ing", "er", "and"], "fr": ["que", "eau", "oi", "é"], "de": ["sch", "ung", "ein", "ü"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[l]) for _ in range(3)) for _ in range(40)), l) for i, l in enumerate(list(syllables) * 40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("held_out", fold(F.col("doc_id")) == 1)
    profiles = learn_profiles(table.where("not held_out"), dim=512)
    out = predict_language(table, profiles).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20 and all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in held)
    odd = predict_language(documents, profiles, keep=["doc_id", "text"]).collect()
    assert len(odd) == documents.count()
    for r in odd:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in profiles.languages
    nothing = learn_profiles(empty, dim=64)
    assert nothing.languages == ()
    assert {r["lang_pred"] for r in predict_language(table, nothing).collect()} == {"und"}
    assert predict_language(empty, profiles).count() == 0


def test_bundles_are_sums_of_bound_letters():
    space = Space(32, 1)
    row, column, number, grams = space.counts(["Ab1 b", None, "xyz xyz"])
    made = space.bundle(row, column, number, grams, 3)
    clean = [" ab b ", " ", " xyz xyz "]
    for text, vector in zip(clean, made):
        want = np.zeros(32)
        for i in range(len(text) - 2):
            want += np.prod([np.roll(space.letter(ord(c)), 2 - k) for k, c in enumerate(text[i : i + 3])], axis=0)
        assert (vector == want).all()


# -- quality --------------------------------------------------------------------------------------


def test_quality_counts(documents, empty):
    rows = quality_rules(documents).collect()
    texts = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect())
    assert len(rows) == sum(texts.values())

    def counts(text):
        w = brute.words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if brute.words(line)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    want = Counter((i, l, s, *counts(t)) for (i, t, l, s), n in texts.items() for _ in range(n))
    assert Counter((r["id"], r["lang"], r["source"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in rows)
    assert not any(r["kept"] for r in rows if r["base_failed"]) and any(r["kept"] for r in rows)
    assert quality_rules(empty).count() == 0


def test_quality_repeats_inside_windows(spark):
    texts = ["a a a a", "a b c x a b c", "a b", "a b c", None, "$ x\n$ x\n \ny"]
    rows = quality_rules(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")).collect()
    by_id = {r["id"]: r for r in rows}
    assert [by_id[i]["n_repeat_words"] for i in range(6)] == [4, 6, 0, 0, 0, 0]
    assert (by_id[5]["n_symbols"], by_id[5]["n_lines"], by_id[5]["n_dup_lines"]) == (2, 3, 1)


# -- licences -------------------------------------------------------------------------------------


def test_licences(spark, documents, empty):
    mit = LICENCES["MIT"]
    rows = [
        (1, "  " + mit.upper().replace(",", " ;") + "\n"),
        (2, "Copyright (c) 2020 Someone & Others\n" + mit.replace("License", "Licence")),
        (3, mit + " and more"),
        (4, "Prose before.\n# Licensed  under CC-BY-NC 4.0\nReleased under the MIT licence!\nProse after."),
        (5, None),
        (6, ""),
        (4, "Released under the MIT License."),
        (None, "Copyright 1999 x"),
    ]
    out = [tuple(r) for r in scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).select("id", "licence", "notices", "digest").collect()]
    found = sorted(((i, l, n) for i, l, n, _ in out), key=str)
    want = [(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "CC-BY-NC-4.0-notice,MIT-notice"), (5, None, ""), (6, None, "")]
    want += [(4, "MIT-notice", "MIT-notice"), (None, None, "")]
    assert found == sorted(want, key=str)
    digests = {i: d for i, _, _, d in out}
    assert digests[1] == digests[2] != digests[3] and digests[5] == digests[6] == hashlib.md5(b"").hexdigest()
    assert scan_licences(documents).count() == documents.count() and scan_licences(empty).count() == 0


def test_licences_wrapped_and_commented(spark, tmp_path):
    states = re.compile(r"^\W*(?:copyright (?:\(c\)|\[yyyy)|all rights reserved)|_____", re.I)

    def refill(text, width):
        """The paragraphs of a text in lines of one width; lines that state a copyright stay lines."""
        out, held = [], []
        for line in [*text.split("\n"), ""]:
            if not line.strip() or states.search(line):
                out += [*textwrap.wrap(" ".join(held), width, break_long_words=False, break_on_hyphens=False), line]
                held = []
            else:
                held.append(line.strip())
        return "\n".join(out)

    names = [n for n in LICENCES if "notice" not in n]
    assert {"Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC"} <= set(names)
    rows = []
    for name in names:
        for width in (50, 66, 72, 100):
            wrapped = "Copyright (c) 2020 Someone\nCopyright 2021 The Others. All rights reserved.\nCopyright The Third Authors\n(c) 2022 Fourth\n\n" + refill(LICENCES[name], width)
            rows += [(name, f"{width}", wrapped), (name, f"# {width}", re.sub("(?m)^", "# ", wrapped)), (name, f"* {width}", "/*\n" + re.sub("(?m)^", " * ", wrapped) + "\n */")]
        rows.append((name, "as published", LICENCES[name]))
    table = spark.createDataFrame([(f"{n} {how}", t) for n, how, t in rows], "doc_id string, text string")
    found = {r["id"]: r["licence"] for r in scan_licences(table).collect()}
    assert {i: l for i, l in found.items() if l != i.split(" ")[0]} == {}
    isc = "copyright notice and this permission notice appear in all copies."
    assert isc in LICENCES["ISC"] and LICENCES["ISC"].replace(isc, "\n" + isc) != LICENCES["ISC"]
    broken = spark.createDataFrame([(1, LICENCES["ISC"].replace(isc, "\n" + isc)), (2, LICENCES["ISC"].replace(isc, "\n * " + isc))], "doc_id int, text string")
    assert [r["licence"] for r in scan_licences(broken).collect()] == ["ISC", "ISC"]

    import duckdb

    from eventgrove.llm.queries import ORACLES, QUERIES

    lines = ["Copyright\r\nCopyright 2020 A\rB", "// copyright  notice of x\n// Copyright  Holder Inc\n(c) You must", "The programme is long. " * 9000, None, ""]
    texts = [t for _, _, t in rows] + [r["text"] for r in broken.collect()] + lines
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op8_licence_scan"]).project("doc_id, digest, licence, notices").fetchall()
    got = QUERIES["op8_licence_scan"](spark, str(tmp_path)).select("doc_id", "digest", "licence", "notices").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


# -- the registered queries against their SQL --------------------------------------------------------

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_top_k", "op5_mix_sources", "op8_licence_scan", "op10_quality_rules"])
def test_query_equals_sql(spark, name):
    import duckdb

    from eventgrove.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = con.sql(ORACLES[name])
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(expected.columns)
    want = sorted(repr(r) for r in expected.project(", ".join(frame.columns)).fetchall())
    assert sorted(repr(tuple(r)) for r in frame.collect()) == want
