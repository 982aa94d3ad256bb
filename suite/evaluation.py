"""Evaluation and corpus-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgrove.functions.tokens import whitespace_tokens
from eventgrove.functions.let import unpacked
from eventgrove.operators.evaluate import (
    argmax_label,
    assign_split,
    binary_prf,
    combined_score,
    count_sentences,
    count_words_sentences,
    decode_bio,
    sense_accuracy,
    span_prf,
    train_validation_split,
)
from eventgrove.operators.mentions import annotate
from eventgrove.operators.spans import frame_spans
from suite.base import CORPUS_SQL, FRAME_SQL, conversations, query, table, texts
from suite.ontology import event_shares


def _span_sets(spark, sf_dir):
    """Gold spans of the rule frames; predictions end every ARG1 one token early and know no ARG0 at the start."""
    rows = unpacked(annotate(conversations(spark, sf_dir)), ["sent_id"], "frames", "frame", "f")
    gold = frame_spans(rows.select("sent_id", "frame", F.col("f.tags").alias("tags")), "sent_id", "frame")
    pred = gold.withColumn(
        "end", F.when((F.col("label") == "ARG1") & (F.col("end") - F.col("start") > 1), F.col("end") - 1).otherwise(F.col("end"))
    ).where((F.col("label") != "ARG0") | (F.col("start") > 0))
    return gold, pred


_PRF_SQL = f"""WITH {FRAME_SQL},
gold AS (SELECT sent_id, frame, label, "start", "end" FROM spans WHERE label <> 'V'),
pred AS (SELECT sent_id, frame, label, "start", CASE WHEN label = 'ARG1' AND "end" - "start" > 1 THEN "end" - 1 ELSE "end" END AS "end" FROM gold WHERE label <> 'ARG0' OR "start" > 0),
b AS (SELECT coalesce(g.label, p.label) AS label, g.sent_id IS NOT NULL AS g, p.sent_id IS NOT NULL AS p
      FROM gold g FULL JOIN pred p ON g.sent_id = p.sent_id AND g.frame = p.frame AND g.label = p.label AND g."start" = p."start" AND g."end" = p."end"),
c AS (SELECT label, count(*) FILTER (g AND p) AS correct, count(*) FILTER (p) AS predicted, count(*) FILTER (g) AS gold FROM b GROUP BY GROUPING SETS ((label), ())),
s AS (SELECT *, correct / CAST(predicted AS DOUBLE) AS prec, correct / CAST(gold AS DOUBLE) AS rec FROM c)
"""


@query(
    "g1_span_prf",
    f"""{_PRF_SQL} SELECT label, correct, predicted, gold, round(prec, 6) AS "precision", round(rec, 6) AS recall,
       round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1 FROM s""",
)
def g1_span_prf(spark, sf_dir):
    scores = span_prf(*_span_sets(spark, sf_dir), ["sent_id", "frame"])
    return scores.select(
        "label", "correct", "predicted", "gold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


def _senses(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    gold = labels.select("doc_id", F.col("quality").cast("string").alias("sense"))
    pred = labels.where("toxic = 0 or quality = 1").select("doc_id", (1 - F.col("toxic")).cast("string").alias("sense"))
    return gold, pred


_ACC = "avg(CASE WHEN (toxic = 0 OR quality = 1) AND quality = 1 - toxic THEN 1.0::DOUBLE ELSE 0 END)"


@query("g2_sense_accuracy", f"SELECT round({_ACC}, 6) AS accuracy FROM labels")
def g2_sense_accuracy(spark, sf_dir):
    accuracy = sense_accuracy(*_senses(spark, sf_dir), ["doc_id"])
    return accuracy.select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "g3_combined_score",
    f"""{_PRF_SQL} SELECT round(2 * prec * rec / (prec + rec) * (SELECT {_ACC} FROM labels), 6) AS combined FROM s WHERE label IS NULL""",
)
def g3_combined_score(spark, sf_dir):
    overall = span_prf(*_span_sets(spark, sf_dir), ["sent_id", "frame"]).where("label is null")
    accuracy = sense_accuracy(*_senses(spark, sf_dir), ["doc_id"])
    return overall.select(F.round(combined_score(F.col("f1"), accuracy.scalar()), 6).alias("combined"))


@query(
    "g4_binary_prf",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS correct, count(*) FILTER (toxic = 0) AS predicted, count(*) FILTER (quality = 1) AS gold FROM labels),
s AS (SELECT *, correct / CAST(predicted AS DOUBLE) AS p, correct / CAST(gold AS DOUBLE) AS r FROM c)
SELECT correct, predicted, gold, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""",
)
def g4_binary_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("guess", 1 - F.col("toxic"))
    scores = binary_prf(rows, "quality", "guess")
    return scores.select("correct", "predicted", "gold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _decode_sql() -> str:
    """Best way to each label, token by token: {s: score, p: labels so far}. Of equal ways the one over the first label."""
    names = ["O", "B-ARG0", "I-ARG0", "B-ARG1", "I-ARG1"]
    before = lambda j: [i for i, n in enumerate(names) if not names[j].startswith("I") or i == j or n == "B" + names[j][1:]]
    first = lambda ways: f"list_sort([{', '.join(ways)}], 'DESC')[1]"
    reach = lambda j: first([f"{{'s': w[{i + 1}].s, 'k': -{i}, 'p': w[{i + 1}].p}}" for i in before(j)])
    step = ", ".join(f"{{'s': ({reach(j)}).s + x[{j + 1}].s, 'k': 0, 'p': ({reach(j)}).p || ' {names[j]}'}}" for j in range(len(names)))
    start = ", ".join(f"{{'s': {'-1e300::DOUBLE' if n.startswith('I') else f'x[{j + 1}].s'}, 'k': 0, 'p': '{n}'}}" for j, n in enumerate(names))
    best = first([f"{{'s': w[{j + 1}].s, 'k': -{j}, 'p': w[{j + 1}].p}}" for j in range(len(names))])
    shares = ", ".join(f"{{'s': {x} / total, 'k': 0, 'p': ''}}" for x in "abcde")
    return f"""WITH {CORPUS_SQL},
raw AS (
  SELECT sent_id AS seq_id, tok_idx, length(token) / (length(token) + 1.0::DOUBLE) AS a, length(token) / 10.0::DOUBLE AS b, 1 / (1.0::DOUBLE + length(token)) AS c,
         CASE WHEN token = '' THEN 0 ELSE unicode(token) END / 200.0::DOUBLE AS d, length(token) / 7.0::DOUBLE AS e FROM tok),
shares AS (SELECT seq_id, tok_idx, [{shares}] AS x FROM (SELECT *, a + b + c + d + e AS total FROM raw)),
seq AS (SELECT seq_id, list(x ORDER BY tok_idx) AS xs FROM shares GROUP BY seq_id),
ways AS (SELECT seq_id, list_reduce(list_prepend(list_transform([xs[1]], lambda x: [{start}])[1], xs[2:]), lambda w, x: [{step}]) AS w FROM seq)
SELECT seq_id, best.p AS tags, round(best.s, 6) AS score FROM (SELECT seq_id, {best} AS best FROM ways)"""


@query("g5_decode_bio", _decode_sql())
def g5_decode_bio(spark, sf_dir):
    """Probabilities from token shapes; many tokens prefer an I- tag that must not come first."""
    corpus = conversations(spark, sf_dir).select(F.col("sent_id").alias("seq_id"), F.posexplode("tokens").alias("pos", "t"))
    n = F.length("t")
    raw = F.array(n / (n + 1.0), n / 10.0, 1 / (1.0 + n), F.ascii("t") / 200.0, n / 7.0)
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    probs = corpus.select("seq_id", "pos", F.transform(raw, lambda x: x / total).alias("probs"))
    decoded = decode_bio(probs, ["O", "B-ARG0", "I-ARG0", "B-ARG1", "I-ARG1"])
    return decoded.select("seq_id", F.array_join("tags", " ").alias("tags"), F.round("score", 6).alias("score"))


@query(
    "g6_argmax_label",
    """WITH share AS (SELECT user_id AS node, event_type AS token, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS prob FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY prob DESC, token) AS n FROM share)
SELECT node, token, round(prob, 6) AS prob FROM r WHERE n = 1""",
)
def g6_argmax_label(spark, sf_dir):
    return argmax_label(event_shares(spark, sf_dir), ["node"], "token", "prob").withColumn("prob", F.round("prob", 6))


def _files(spark, sf_dir):
    """Treebank-like file names from customers: the nation is the section."""
    section = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    file = F.concat(F.lit("wsj/"), section, F.lit("/wsj_"), section, F.lit("01.mrg"))
    return table(spark, sf_dir, "customer").select(file.alias("file"), F.floor(F.col("c_custkey") / 3).alias("sentnum")).withColumn(
        "split", assign_split(F.col("file"))
    )


_FILES_SQL = """
f AS (SELECT 'wsj/' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '/wsj_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '01.mrg' AS file,
             CAST(floor(c_custkey / 3) AS BIGINT) AS sentnum,
             CASE WHEN c_nationkey = 23 THEN 'test' WHEN c_nationkey IN (0, 1, 22, 24) THEN 'dev' ELSE 'train' END AS split FROM customer)
"""


@query("g7_assign_split", f"WITH {_FILES_SQL} SELECT file, sentnum, split FROM f")
def g7_assign_split(spark, sf_dir):
    return _files(spark, sf_dir)


@query("g8_count_sentences", f"WITH {_FILES_SQL} SELECT split, count(DISTINCT file || ' ' || sentnum) AS sentences FROM f GROUP BY split")
def g8_count_sentences(spark, sf_dir):
    return count_sentences(_files(spark, sf_dir))


@query(
    "g9_count_words_sentences",
    r"""WITH l AS (SELECT doc_id, lang, source, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line FROM documents),
w AS (SELECT lang, source, doc_id, unnest(range(len(string_split_regex(trim(line), '\s+')))) AS word_num FROM l)
SELECT lang AS split, source AS genre, count(*) AS words, count(*) FILTER (word_num = 0) AS sentences, count(*) FILTER (doc_id > 500) AS foreign_ids
FROM w GROUP BY ROLLUP (lang, source)""",
)
def g9_count_words_sentences(spark, sf_dir):
    lines = texts(spark, sf_dir, "documents").select(
        F.col("lang").alias("split"),
        F.col("source").alias("genre"),
        # Documents after number 500 carry an id of another folder.
        F.concat(F.when(F.col("doc_id") > 500, "elsewhere").otherwise(F.col("source")), F.lit("/x")).alias("doc_id"),
        F.explode(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")).alias("line"),
    )
    words = lines.select("split", "genre", "doc_id", F.posexplode(whitespace_tokens(F.col("line"))).alias("word_num", "word"))
    return count_words_sentences(words)


@query(
    "g10_train_validation_split",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM labels)
SELECT CASE WHEN place < floor(n * 0.1) THEN 'validation' ELSE 'train' END AS part, doc_id, quality FROM r""",
)
def g10_train_validation_split(spark, sf_dir):
    train, validation = train_validation_split(table(spark, sf_dir, "labels"), "doc_id", ordered=True)
    return train.select(F.lit("train").alias("part"), "doc_id", "quality").unionByName(
        validation.select(F.lit("validation").alias("part"), "doc_id", "quality")
    )


@query(
    "g10_hash_split",
    """SELECT CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.1 THEN 'validation' ELSE 'train' END AS part, doc_id FROM labels""",
)
def g10_hash_split(spark, sf_dir):
    train, validation = train_validation_split(table(spark, sf_dir, "labels"), "doc_id", seed=42)
    return train.select(F.lit("train").alias("part"), "doc_id").unionByName(
        validation.select(F.lit("validation").alias("part"), "doc_id")
    )
