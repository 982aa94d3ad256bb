"""Token, span and tag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgrove.functions import tags as tg
from eventgrove.functions import tokens as tk
from eventgrove.functions.let import let, unpacked
from eventgrove.operators.mentions import annotate, mention_column
from eventgrove.operators.spans import (
    align_event_labels,
    candidate_predicates,
    drop_blank_tokens,
    drop_traces,
    frame_spans,
    multiword_groups,
    predicate_argument_graph,
    spans_to_bio,
    split_compounds,
    strip_hyphen_suffix,
    text_annotation,
)
from eventgrove.sources.annotated import parse_span_lines
from suite.base import CORPUS_SQL, FRAME_SQL, conversations, joined, query, table, texts
from suite.corpus import span_lines

URL_SQL = r"""
url AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS old, parts[i] AS token
        FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split_regex(url, '[.?=&:]') AS parts FROM pages)))
"""


def url_tokens(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", F.split("url", "[.?=&:]").alias("tokens"))


def _compounds_sql(cut: str) -> str:
    return f"""WITH {URL_SQL},
p AS (SELECT page_id, old, CASE WHEN regexp_matches(token, '^[-/]') THEN [token] ELSE {cut} END AS pieces FROM url),
q AS (SELECT *, CAST(coalesce(sum(len(pieces)) OVER (PARTITION BY page_id ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM p)
SELECT page_id, array_to_string(flatten(list(pieces ORDER BY old)), '|') AS new_tokens,
       string_agg(array_to_string(list_transform(range("at", "at" + len(pieces)), lambda x: CAST(x AS VARCHAR)), ','), ';' ORDER BY old) AS new_indices
FROM q GROUP BY page_id""".replace(" AS at FROM", ' AS "at" FROM')


def _compounds(spark, sf_dir, mode):
    return split_compounds(url_tokens(spark, sf_dir), mode).select(
        "page_id",
        joined("new_tokens", "|").alias("new_tokens"),
        F.array_join(F.transform("new_indices", lambda places: joined(places, ",")), ";").alias("new_indices"),
    )


_SEPARATE = r"string_split(regexp_replace(token, '([-/])', chr(1) || '\1' || chr(1), 'g'), chr(1))"


@query("b1_split_compounds", _compounds_sql(f"CASE WHEN {_SEPARATE}[-1] = '' THEN {_SEPARATE}[:-2] ELSE {_SEPARATE} END"))
def b1_split_compounds(spark, sf_dir):
    return _compounds(spark, sf_dir, "separate")


@query("b2_split_compounds_attach", _compounds_sql(r"string_split(regexp_replace(token, '([-/])', '\1' || chr(1), 'g'), chr(1))"))
def b2_split_compounds_attach(spark, sf_dir):
    return _compounds(spark, sf_dir, "attach")


@query(
    "b3_indicator_to_indices",
    f"""WITH {CORPUS_SQL}
SELECT c.sent_id, coalesce((SELECT string_agg(CAST(tok_idx AS VARCHAR), ' ' ORDER BY tok_idx) FROM mention m WHERE m.sent_id = c.sent_id AND kind = 'nom'), '') AS indices
FROM corpus c""",
)
def b3_indicator_to_indices(spark, sf_dir):
    nominal = lambda t: F.coalesce(tk.token_kind(tk.token_form(t)) == "nom", F.lit(False)).cast("int")
    indicated = conversations(spark, sf_dir).select("sent_id", F.transform("tokens", nominal).alias("nominals"))
    return indicated.select("sent_id", joined(tk.ones(F.col("nominals"))).alias("indices"))


@query(
    "b4_drop_blank_tokens",
    r"""WITH url AS (SELECT page_id, i - 1 AS old, parts[i] AS token
        FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split_regex(url, '[-/.:]') AS parts FROM pages))),
k AS (SELECT *, sum(CASE WHEN trim(token) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY old) - 1 AS new FROM url)
SELECT page_id, string_agg(token, ' ' ORDER BY old) FILTER (trim(token) <> '') AS text,
       coalesce(string_agg(CAST(CAST(new AS BIGINT) AS VARCHAR), ' ' ORDER BY old) FILTER (trim(token) <> '' AND length(token) <> 2), '') AS indices
FROM k GROUP BY page_id""",
)
def b4_drop_blank_tokens(spark, sf_dir):
    rows = texts(spark, sf_dir, "pages").select("page_id", F.split("url", "[-/.:]").alias("tokens"))
    # Indices of blank tokens are among them and must go away.
    marked = rows.withColumn("indices", tk.positions_where(F.col("tokens"), lambda t: F.length(t) != 2))
    return drop_blank_tokens(marked).select("page_id", "text", joined("indices").alias("indices"))


@query(
    "b5_token_offsets",
    """WITH t AS (SELECT conv_id || '-' || turn AS sent_id, string_split(text, ' ') AS parts FROM conversations),
u AS (SELECT sent_id, parts[i] AS form, i FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM t))
SELECT sent_id, form, CAST(coalesce(sum(length(form) + 1) OVER w, 0) AS INTEGER) AS "start",
       CAST(coalesce(sum(length(form) + 1) OVER w, 0) + length(form) AS INTEGER) AS "end"
FROM u WINDOW w AS (PARTITION BY sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def b5_token_offsets(spark, sf_dir):
    return unpacked(conversations(spark, sf_dir), ["sent_id"], tk.token_offsets(F.col("sentence")), "s").select("sent_id", "s.*")


_DOTTED = r"string_split_regex(trim(replace(text, '.', ' . ')), '\s+')"


def dotted(spark, sf_dir):
    """Conversation turns with each full stop as a token."""
    spaced = texts(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"\.", " . "))
    return spaced.select(F.concat_ws("-", "conv_id", "turn").alias("sent_id"), tk.whitespace_tokens(F.col("text")).alias("tokens"))


@query(
    "b6_sentence_spans",
    f"""WITH t AS (SELECT conv_id || '-' || turn AS sent_id, {_DOTTED} AS parts FROM conversations),
e AS (SELECT sent_id, CAST(i AS INTEGER) AS "end" FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM t) WHERE parts[i] = '.')
SELECT sent_id, coalesce(lag("end") OVER (PARTITION BY sent_id ORDER BY "end"), 0) AS "start", "end" FROM e""",
)
def b6_sentence_spans(spark, sf_dir):
    return unpacked(dotted(spark, sf_dir), ["sent_id"], tk.sentence_spans(F.col("tokens")), "s").select("sent_id", "s.*")


@query("b7_token_spans", f'WITH {CORPUS_SQL} SELECT sent_id, token AS form, tok_idx AS "start", tok_idx + 1 AS "end" FROM tok')
def b7_token_spans(spark, sf_dir):
    return unpacked(conversations(spark, sf_dir), ["sent_id"], tk.token_spans(F.col("tokens")), "s").select("sent_id", "s.*")


_BIO_SQL = f"""WITH {FRAME_SQL},
s AS (SELECT sent_id, frame, string_agg(replace(tag, '-V', '-rel'), ' ' ORDER BY tok_idx) AS tags FROM tag GROUP BY sent_id, frame)
SELECT 'conv-' || split_part(sent_id, '-', 1) AS file, CAST(split_part(sent_id, '-', 2) AS INTEGER) AS sentnum, tags FROM s"""


def _bio(lines, policy):
    split = split_compounds(parse_span_lines(lines))
    tags = spans_to_bio(F.col("arguments"), F.col("new_indices"), F.size("new_tokens"), policy)
    return split.select("file", "sentnum", joined(tags).alias("tags"))


@query("b8_spans_to_bio", _BIO_SQL)
def b8_spans_to_bio(spark, sf_dir):
    # A modifier over the whole of ARG1 gives way to it, wherever ARG1 is.
    lines = span_lines(spark, sf_dir).withColumn(
        "value", F.regexp_replace("value", r" (\d+):(\d+)-ARG1$", " $1:$2-ARG1 $1:$2-ARGM-TMP")
    )
    return _bio(lines, "priority")


@query("b9_spans_to_bio_dominated", _BIO_SQL)
def b9_spans_to_bio_dominated(spark, sf_dir):
    # An ARG2 inside ARG1 is dominated by it.
    lines = span_lines(spark, sf_dir).withColumn(
        "value", F.regexp_replace("value", r" (\d+):(\d+)-ARG1$", " $1:$2-ARG1 $2:$2-ARG2")
    )
    return _bio(lines, "dominated")


@query(
    "b10_brackets_to_bio",
    f"WITH {FRAME_SQL} SELECT sent_id, frame, string_agg(tag, ' ' ORDER BY tok_idx) AS tags FROM tag GROUP BY sent_id, frame",
)
def b10_brackets_to_bio(spark, sf_dir):
    def cells(tokens, at):
        n = F.size(tokens)
        return F.transform(
            tokens,
            lambda t, i: F.when(i == at, "(V*)")
            .when(i == at - 1, "(ARG0*)")
            .when((i == at + 1) & (at + 2 < n), "(ARG1*")
            .when(i == at + 1, "(ARG1*)")
            .when(i == at + 2, "*)")
            .otherwise("*"),
        )

    rows = unpacked(conversations(spark, sf_dir), ["sent_id", "tokens"], mention_column(F.col("tokens")), "frame", "m")
    column = rows.select("sent_id", "frame", cells(F.col("tokens"), F.col("m.tok_idx")).alias("cells"))
    return column.select("sent_id", "frame", joined(tg.bracket_tags(F.col("cells"))).alias("tags"))


@query(
    "b11_bio_to_spans",
    f'WITH {FRAME_SQL} SELECT sent_id, frame, label, "start", "end" FROM spans',
)
def b11_bio_to_spans(spark, sf_dir):
    rows = unpacked(annotate(conversations(spark, sf_dir)), ["sent_id"], "frames", "frame", "f")
    return frame_spans(rows.select("sent_id", "frame", F.col("f.tags").alias("tags")), "sent_id", "frame")


@query(
    "b12_frame_description",
    f"""WITH {FRAME_SQL},
n AS (SELECT *, lead(tag) OVER (PARTITION BY sent_id, frame ORDER BY tok_idx) AS next FROM tag)
SELECT sent_id, frame, string_agg(CASE WHEN tag LIKE 'B-%' THEN '[' || substr(tag, 3) || ': ' ELSE '' END || token ||
       CASE WHEN tag <> 'O' AND coalesce(next, 'O') NOT LIKE 'I-%' THEN ']' ELSE '' END, ' ' ORDER BY tok_idx) AS description
FROM n GROUP BY sent_id, frame""",
)
def b12_frame_description(spark, sf_dir):
    rows = unpacked(annotate(conversations(spark, sf_dir)), ["sent_id", "words"], "frames", "frame", "f")
    return rows.select("sent_id", "frame", tg.frame_text(F.col("words"), F.col("f.tags")).alias("description"))


@query(
    "b12_frame_description_open",
    f"""WITH {FRAME_SQL},
l AS (SELECT *, coalesce(max(CASE WHEN tag LIKE 'I-%' THEN tok_idx END) OVER (PARTITION BY sent_id, frame), -1) AS last_inside FROM tag)
SELECT sent_id, frame, trim(coalesce(string_agg(token, ' ' ORDER BY tok_idx) FILTER (tag = 'O'), '') ||
       coalesce(' [' || string_agg(substr(tag, 3) || ': ' || token, ' ' ORDER BY tok_idx) FILTER (tag LIKE 'B-%' AND tok_idx > last_inside) || ']', '')) AS description
FROM l GROUP BY sent_id, frame""",
)
def b12_frame_description_open(spark, sf_dir):
    rows = unpacked(annotate(conversations(spark, sf_dir)), ["sent_id", "words"], "frames", "frame", "f")
    return rows.select("sent_id", "frame", tg.frame_text(F.col("words"), F.col("f.tags"), "open").alias("description"))


@query(
    "b13_predicate_argument_graph",
    f"""WITH {FRAME_SQL},
c AS (
  SELECT sent_id, frame, true AS is_predicate, predicate AS label, "at" AS "start", "at" + 1 AS "end" FROM (SELECT DISTINCT sent_id, frame, predicate, "at" FROM tag)
  UNION ALL
  SELECT sent_id, frame, false, label, "start", "end" FROM spans WHERE label <> 'V'),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY frame, is_predicate DESC, "start") - 1 AS INTEGER) AS id FROM c)
SELECT a.sent_id, a.label AS relation, p.id AS src, a.id AS target, p.label AS predicate, a."start", a."end"
FROM n a JOIN n p ON a.sent_id = p.sent_id AND a.frame = p.frame AND p.is_predicate WHERE NOT a.is_predicate""",
)
def b13_predicate_argument_graph(spark, sf_dir):
    graph = predicate_argument_graph(annotate(conversations(spark, sf_dir)))
    row = lambda all_nodes, r: F.struct(
        r["relation"].alias("relation"),
        r["src"].alias("src"),
        r["target"].alias("target"),
        F.get(all_nodes, r["src"])["label"].alias("predicate"),
        F.get(all_nodes, r["target"])["start"].alias("start"),
        F.get(all_nodes, r["target"])["end"].alias("end"),
    )
    rows = let(F.col("constituents"), body=lambda nodes: F.transform("relations", lambda r: row(nodes, r)))
    return unpacked(graph, ["sent_id"], rows, "r").select("sent_id", "r.*")


@query(
    "b14_text_annotation",
    f"""WITH {FRAME_SQL},
len AS (SELECT sent_id, CAST(sum(length(token) + 1) - 1 AS INTEGER) AS last_char FROM tok GROUP BY sent_id),
a AS (SELECT sent_id, count(*) FILTER (label <> 'V') AS arguments, count(DISTINCT frame) AS frames FROM spans GROUP BY sent_id)
SELECT c.sent_id, CAST(len(c.tokens) AS INTEGER) AS n_tokens, l.last_char, CAST(coalesce(a.arguments + a.frames, 0) AS INTEGER) AS constituents,
       CAST(coalesce(a.arguments, 0) AS INTEGER) AS relations, c.sentence AS text
FROM corpus c JOIN len l USING (sent_id) LEFT JOIN a USING (sent_id)""",
)
def b14_text_annotation(spark, sf_dir):
    corpus = conversations(spark, sf_dir)
    frames = annotate(corpus).select("sent_id", "frames")
    record = text_annotation(corpus.join(frames, "sent_id"))
    a = "annotation"
    return record.select(
        "sent_id",
        F.size(f"{a}.tokens").alias("n_tokens"),
        F.element_at(f"{a}.token_offsets", -1)["end"].alias("last_char"),
        F.size(f"{a}.views.constituents").alias("constituents"),
        F.size(f"{a}.views.relations").alias("relations"),
        F.col(f"{a}.text").alias("text"),
    )


def piece_counts(tokens):
    """Stand-in for a sub-word tokenizer: a piece per started five characters."""
    return F.transform(tokens, lambda t: F.floor((F.length(t) + 4) / 5).cast("int"))


_PIECES = "CAST(floor((length(token) + 4) / 5) AS INTEGER)"


def framed(spark, sf_dir):
    # Pieces belong to the sentence, whatever the number of its frames.
    sentences = annotate(conversations(spark, sf_dir)).withColumn("n_pieces", piece_counts(F.col("words")))
    offsets = F.transform(tk.piece_offsets(F.col("n_pieces"), cap=1 << 30), lambda s: s["start"])
    rows = unpacked(sentences.withColumn("starts", offsets), ["sent_id", "words", "n_pieces", "starts"], "frames", "frame", "f")
    return rows.select("sent_id", "frame", "words", F.col("f.tags").alias("tags"), "n_pieces", "starts")


@query(
    "b15_expand_labels",
    f"""WITH {FRAME_SQL},
p AS (SELECT *, {_PIECES} AS n, 'I' || substr(tag, 2) AS inside FROM tag)
SELECT sent_id, frame, 'O ' || string_agg(CASE WHEN tag LIKE 'B-%' THEN trim(tag || repeat(' ' || inside, n - 1)) ELSE trim(repeat(' ' || tag, n)) END, ' ' ORDER BY tok_idx) || ' O' AS labels
FROM p GROUP BY sent_id, frame""",
)
def b15_expand_labels(spark, sf_dir):
    return framed(spark, sf_dir).select(
        "sent_id", "frame", joined(tk.expand_labels(F.col("tags"), F.col("n_pieces"))).alias("labels")
    )


@query(
    "b16_expand_indicator",
    f"""WITH {FRAME_SQL},
p AS (SELECT *, {_PIECES} AS n FROM tag)
SELECT sent_id, frame, '0' || string_agg(repeat(CASE WHEN tag = 'B-V' THEN '1' ELSE '0' END, n), '' ORDER BY tok_idx) || '0' AS indicator
FROM p GROUP BY sent_id, frame""",
)
def b16_expand_indicator(spark, sf_dir):
    rows = framed(spark, sf_dir).withColumn("bits", F.transform("tags", lambda t: (t == "B-V").cast("int")))
    return rows.select("sent_id", "frame", joined(tk.expand_indicator(F.col("bits"), F.col("n_pieces")), "").alias("indicator"))


@query(
    "b17_piece_offsets",
    f"""WITH {CORPUS_SQL},
p AS (SELECT sent_id, tok_idx AS word, {_PIECES} AS n FROM tok),
s AS (SELECT sent_id, word, n, CAST(sum(n) OVER (PARTITION BY sent_id ORDER BY word) AS INTEGER) AS "end" FROM p)
SELECT sent_id, word, "end" - n + 1 AS "start", "end" FROM s WHERE "end" <= 100""",
)
def b17_piece_offsets(spark, sf_dir):
    spans = tk.piece_offsets(piece_counts(F.col("tokens")), cap=100)
    return unpacked(conversations(spark, sf_dir), ["sent_id"], spans, "word", "s").select(
        "sent_id", "word", F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )


@query(
    "b18_collapse_to_words",
    f"WITH {FRAME_SQL} SELECT sent_id, frame, string_agg(tag, ' ' ORDER BY tok_idx) AS tags FROM tag GROUP BY sent_id, frame",
)
def b18_collapse_to_words(spark, sf_dir):
    pieces = framed(spark, sf_dir).select(
        "sent_id",
        "frame",
        tk.expand_labels(F.col("tags"), F.col("n_pieces")).alias("labels"),
        "starts",
    )
    return pieces.select("sent_id", "frame", joined(tk.collapse_to_words(F.col("labels"), F.col("starts"))).alias("tags"))


@query(
    "b19_align_event_labels",
    f"""WITH {CORPUS_SQL},
p AS (SELECT sent_id, tok_idx, {_PIECES} AS n, CASE kind WHEN 'verb' THEN 1 WHEN 'nom' THEN 0 ELSE -100 END AS label FROM tagged)
SELECT sent_id, '-100 ' || string_agg(trim(CAST(label AS VARCHAR) || repeat(' -100', n - 1)), ' ' ORDER BY tok_idx) || ' -100' AS labels,
       '0' || string_agg(CASE WHEN label <> -100 THEN '1' ELSE '0' END || repeat('0', n - 1), '' ORDER BY tok_idx) || '0' AS type_ids
FROM p GROUP BY sent_id""",
)
def b19_align_event_labels(spark, sf_dir):
    tokens = F.col("tokens")
    none = F.array(F.lit(None).cast("int"))
    words = F.flatten(F.transform(piece_counts(tokens), lambda n, i: F.array_repeat(i, n)))
    rows = conversations(spark, sf_dir).select(
        "sent_id", F.concat(none, words, none).alias("word_ids"), mention_column(tokens).alias("m")
    )
    events = rows.select(
        "sent_id",
        "word_ids",
        F.transform("m", lambda m: F.array(m["tok_idx"], m["tok_idx"] + 1)).alias("event_index"),
        F.transform("m", lambda m: (m["kind"] == "verb").cast("int")).alias("saliency"),
    )
    return align_event_labels(events).select("sent_id", joined("labels").alias("labels"), joined("type_ids", "").alias("type_ids"))


def with_pos(spark, sf_dir):
    """Rule parts of speech: verbs and nominals by suffix, short words as adpositions."""
    kind = lambda t: tk.token_kind(tk.token_form(t))
    pos = lambda t: (
        F.when(kind(t) == "verb", "VERB").when(kind(t) == "nom", "NOUN").when(F.length(t) <= 3, "ADP").otherwise("X")
    )
    return conversations(spark, sf_dir).select("sent_id", "tokens", F.transform("tokens", pos).alias("pos"))


_POS_SQL = (
    CORPUS_SQL
    + """,
pos AS (SELECT *, CASE WHEN kind = 'verb' THEN 'VERB' WHEN kind = 'nom' THEN 'NOUN' WHEN length(token) <= 3 THEN 'ADP' ELSE 'X' END AS pos FROM tagged)
"""
)


@query("b20_candidate_predicates", f"WITH {_POS_SQL} SELECT sent_id, tok_idx, token, pos FROM pos WHERE pos IN ('NOUN', 'VERB')")
def b20_candidate_predicates(spark, sf_dir):
    return candidate_predicates(with_pos(spark, sf_dir), ("NOUN", "VERB"))


@query("b20_candidate_predicates_prefix", f"WITH {_POS_SQL} SELECT sent_id, tok_idx, token, pos FROM pos WHERE pos LIKE 'NO%'")
def b20_candidate_predicates_prefix(spark, sf_dir):
    return candidate_predicates(with_pos(spark, sf_dir), prefix="NO")


@query(
    "b21_multiword_groups",
    f"""WITH {_POS_SQL},
r AS (SELECT *, tok_idx - row_number() OVER (PARTITION BY sent_id ORDER BY tok_idx) AS run FROM pos WHERE pos = 'ADP'),
g AS (SELECT *, (row_number() OVER (PARTITION BY sent_id, run ORDER BY tok_idx) - 1) // 3 AS chunk FROM r)
SELECT sent_id, string_agg(CAST(tok_idx AS VARCHAR), ' ' ORDER BY tok_idx) AS indices, string_agg(token, ' ' ORDER BY tok_idx) AS text
FROM g GROUP BY sent_id, run, chunk""",
)
def b21_multiword_groups(spark, sf_dir):
    return multiword_groups(with_pos(spark, sf_dir)).select("sent_id", joined("indices").alias("indices"), "text")


@query(
    "b22_drop_traces",
    f"""WITH {CORPUS_SQL},
k AS (SELECT *, length(token) > 2 AS kept, sum(CASE WHEN length(token) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY tok_idx) - 1 AS new FROM tok)
SELECT sent_id, coalesce(string_agg(token, ' ' ORDER BY tok_idx) FILTER (kept), '') AS words,
       string_agg(CAST(CASE WHEN kept THEN CAST(new AS BIGINT) ELSE -1 END AS VARCHAR), ' ' ORDER BY tok_idx) AS new_indices
FROM k GROUP BY sent_id""",
)
def b22_drop_traces(spark, sf_dir):
    leaf = lambda t: F.struct(t.alias("word"), F.when(F.length(t) > 2, "NN").otherwise("-NONE-").alias("pos"))
    words, places = drop_traces(F.col("leaves"))
    rows = conversations(spark, sf_dir).select("sent_id", F.transform("tokens", leaf).alias("leaves"))
    return rows.select("sent_id", joined(words).alias("words"), joined(places).alias("new_indices"))


@query(
    "b23_strip_hyphen_suffix",
    "SELECT p_partkey, p_type AS label, right(CAST(p_size AS VARCHAR), 1) || ' 1' AS parts FROM part",
)
def b23_strip_hyphen_suffix(spark, sf_dir):
    marked = F.concat("p_type", F.lit("-H"), F.right(F.col("p_size").cast("string"), F.lit(1)), F.lit("-H1"))
    label, parts = strip_hyphen_suffix(marked)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), joined(parts).alias("parts"))
