"""Mention and salience queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventgrove.operators.corpus import corpus_from_lines
from eventgrove.operators.mentions import (
    annotate,
    dedupe_mentions,
    document_candidates,
    document_lengths,
    event_counts,
    join_lexicon,
    mentions_from_frames,
)
from eventgrove.operators.salience import (
    attach_scores,
    rank_in_document,
    salience_features,
    score_learned,
    score_tfidf,
    scores_from_wire,
    top_percentile,
)
from eventgrove.plans.salient import salient_event_counts, salient_events, salient_mentions
from suite.base import CORPUS_SQL, FRAME_SQL, benchmark_lemmas, conversation_mentions, conversations, query, texts


@query(
    "c1_annotate",
    f"""WITH {FRAME_SQL}
SELECT m.doc_id, m.sent_id, m.kind, m.tok_idx, m.token, m.lemma, CASE m.kind WHEN 'verb' THEN '1.0' ELSE '1' END AS sense FROM mention m""",
)
def c1_annotate(spark, sf_dir):
    corpus = conversations(spark, sf_dir)
    return mentions_from_frames(corpus, annotate(corpus)).select(
        "doc_id", "sent_id", "kind", "tok_idx", "token", "lemma", "sense"
    )


@query(
    "c2_assemble_documents",
    f"WITH {CORPUS_SQL} SELECT doc_id, sent_id, kind, tok_idx, sent_offset, doc_tok_idx FROM placed",
)
def c2_assemble_documents(spark, sf_dir):
    return conversation_mentions(spark, sf_dir)[1].select("doc_id", "sent_id", "kind", "tok_idx", "sent_offset", "doc_tok_idx")


@query(
    "c2_document_lengths",
    f"""WITH {CORPUS_SQL}
SELECT o.doc_id, o.sent_id, o.sent_offset, CAST(len(c.tokens) AS INTEGER) AS n_tokens,
       (SELECT count(*) FILTER (kind = 'verb') FROM mention m WHERE m.sent_id = o.sent_id) AS verbs_len,
       (SELECT count(*) FILTER (kind = 'nom') FROM mention m WHERE m.sent_id = o.sent_id) AS noms_len
FROM offs o JOIN corpus c USING (sent_id)""",
)
def c2_document_lengths(spark, sf_dir):
    return document_lengths(*conversation_mentions(spark, sf_dir)).select(
        "doc_id", "sent_id", "sent_offset", "n_tokens", "verbs_len", "noms_len"
    )


def _wide_nominals(mentions):
    """Nominals that also hold the next token, so that they meet verbs."""
    return mentions.withColumn(
        "indices", F.when(F.col("kind") == "nom", F.array(F.col("tok_idx"), F.col("tok_idx") + 1)).otherwise(F.col("indices"))
    )


@query(
    "c3_document_candidates",
    f"""WITH {CORPUS_SQL}
SELECT DISTINCT doc_id, doc_tok_idx AS "start", doc_tok_idx + CASE kind WHEN 'nom' THEN 2 ELSE 1 END AS "end" FROM placed""",
)
def c3_document_candidates(spark, sf_dir):
    return document_candidates(_wide_nominals(conversation_mentions(spark, sf_dir)[1]))


@query("c4_score_tfidf", f"WITH {CORPUS_SQL} SELECT doc_id, doc_tok_idx, score FROM scored")
def c4_score_tfidf(spark, sf_dir):
    annotated, mentions = conversation_mentions(spark, sf_dir)
    n_docs = annotated.select(F.count_distinct("doc_id")).first()[0]
    return score_tfidf(mentions, n_docs)


@query("c4_score_learned")
def c4_score_learned(spark, sf_dir):
    annotated, mentions = conversation_mentions(spark, sf_dir)
    n_docs = annotated.select(F.count_distinct("doc_id")).first()[0]
    # Stand-in labels: events of the first turn are salient.
    labels = mentions.select("doc_id", "doc_tok_idx", (F.col("sent_num") == 0).cast("int").alias("saliency"))
    return score_learned(salience_features(mentions, n_docs), labels)


@query(
    "c5_attach_scores",
    f"""WITH {CORPUS_SQL}
SELECT doc_id, sent_id, doc_tok_idx, kind, CASE WHEN doc_tok_idx < 200 THEN score END AS score, CASE WHEN doc_tok_idx < 200 THEN 1 END AS saliency FROM scored""",
)
def c5_attach_scores(spark, sf_dir):
    annotated, mentions = conversation_mentions(spark, sf_dir)
    n_docs = annotated.select(F.count_distinct("doc_id")).first()[0]
    # A scorer that reads 200 tokens of a document and answers with arrays.
    seen = score_tfidf(mentions, n_docs).where("doc_tok_idx < 200")
    pairs = F.sort_array(F.collect_list(F.struct("doc_tok_idx", "score")))
    wire = seen.groupBy("doc_id").agg(pairs.alias("p")).select(
        "doc_id",
        F.transform("p", lambda p: p["doc_tok_idx"]).alias("event_start_idx"),
        F.transform("p", lambda p: p["score"]).alias("pred"),
        F.transform("p", lambda p: F.lit(1)).alias("saliency"),
    )
    return attach_scores(mentions, scores_from_wire(wire), annotated).select(
        "doc_id", "sent_id", "doc_tok_idx", "kind", "score", "saliency"
    )


def _scored(spark, sf_dir):
    annotated, mentions = conversation_mentions(spark, sf_dir)
    n_docs = annotated.select(F.count_distinct("doc_id")).first()[0]
    return attach_scores(mentions, score_tfidf(mentions, n_docs))


@query("c6_rank_in_document", f"WITH {CORPUS_SQL} SELECT doc_id, doc_tok_idx, kind, score, ranking, total_pred FROM ranked")
def c6_rank_in_document(spark, sf_dir):
    return rank_in_document(_scored(spark, sf_dir)).select("doc_id", "doc_tok_idx", "kind", "score", "ranking", "total_pred")


@query(
    "c6_rank_in_document_compat",
    f"""WITH {CORPUS_SQL},
place AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_tok_idx, kind) - 1 AS place FROM ranked)
SELECT a.doc_id, a.doc_tok_idx, a.kind, b.place AS ranking, a.total_pred
FROM place a JOIN place b ON a.doc_id = b.doc_id AND b.ranking = a.place""",
)
def c6_rank_in_document_compat(spark, sf_dir):
    return rank_in_document(_scored(spark, sf_dir), "compat").select("doc_id", "doc_tok_idx", "kind", "ranking", "total_pred")


@query(
    "c7_top_percentile",
    f"WITH {CORPUS_SQL} SELECT doc_id, doc_tok_idx, kind, ranking FROM ranked WHERE ranking <= floor(CAST(0.1 AS DOUBLE) * total_pred)",
)
def c7_top_percentile(spark, sf_dir):
    return top_percentile(rank_in_document(_scored(spark, sf_dir)), 0.1).select("doc_id", "doc_tok_idx", "kind", "ranking")


@query(
    "c8_event_counts",
    f"WITH {CORPUS_SQL} SELECT kind, count(*) AS events, count(DISTINCT sent_id) AS sentences FROM mention GROUP BY kind",
)
def c8_event_counts(spark, sf_dir):
    return event_counts(conversation_mentions(spark, sf_dir)[1])


@query(
    "c9_dedupe_mentions",
    f"""WITH {CORPUS_SQL},
e AS (SELECT doc_id, sent_id, kind, tok_idx, unnest(CASE kind WHEN 'nom' THEN [tok_idx, tok_idx + 1] ELSE [tok_idx] END) AS token_index FROM mention),
r AS (SELECT *, row_number() OVER (PARTITION BY sent_id, token_index ORDER BY kind DESC, tok_idx) AS n FROM e)
SELECT doc_id, sent_id, kind, tok_idx, token_index FROM r WHERE n = 1""",
)
def c9_dedupe_mentions(spark, sf_dir):
    mentions = _wide_nominals(conversation_mentions(spark, sf_dir)[1])
    return dedupe_mentions(mentions).select("doc_id", "sent_id", "kind", "tok_idx", "token_index")


BENCH_SQL = r"""
word AS (SELECT DISTINCT regexp_replace(lower(t), '[^\p{L}]+$', '') AS form
         FROM (SELECT unnest(string_split_regex(trim(text), '\s+')) AS t FROM benchmark)),
known AS (SELECT form, regexp_replace(form, '^(.+?)(ed|ing|er|tion|ment)$', '\1') AS lemma FROM word WHERE form <> '')
"""


@query(
    "c10_join_lexicon",
    f"""WITH {CORPUS_SQL}, {BENCH_SQL}
SELECT m.sent_id, m.tok_idx, m.form, CASE WHEN k.form IS NULL THEN NULL WHEN length(k.form) > 5 THEN 'NOUN' ELSE 'VERB' END AS pos,
       CASE WHEN k.form IS NULL THEN m.lemma ELSE upper(k.lemma) END AS lemma
FROM mention m LEFT JOIN known k USING (form)""",
)
def c10_join_lexicon(spark, sf_dir):
    lexicon = benchmark_lemmas(spark, sf_dir).select(
        F.col("form").alias("token"), F.when(F.length("form") > 5, "NOUN").otherwise("VERB").alias("pos"), F.upper("lemma").alias("lemma")
    )
    return join_lexicon(conversation_mentions(spark, sf_dir)[1], lexicon).select("sent_id", "tok_idx", "form", "pos", "lemma")


_SALIENT = """,
top AS (SELECT * FROM ranked WHERE ranking <= floor(CAST(0.1 AS DOUBLE) * total_pred))
"""


@query(
    "c11_salient_events",
    f"WITH {CORPUS_SQL}{_SALIENT} SELECT doc_id, sent_id, doc_tok_idx, kind, token, lemma, score, ranking, total_pred FROM top",
)
def c11_salient_events(spark, sf_dir):
    return salient_events(conversations(spark, sf_dir))


@query(
    "c11_salient_event_counts",
    f"""WITH {CORPUS_SQL}{_SALIENT}
SELECT doc_id, count(*) FILTER (kind = 'verb') AS verbs, count(*) FILTER (kind = 'nom') AS noms, count(*) AS events FROM top GROUP BY doc_id""",
)
def c11_salient_event_counts(spark, sf_dir):
    return salient_event_counts(salient_mentions(conversations(spark, sf_dir)))


_DOCUMENT_SQL = CORPUS_SQL.replace(
    CORPUS_SQL[CORPUS_SQL.index("corpus AS (") : CORPUS_SQL.index("tok AS (")],
    r"""corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || '-' || (i - 1) AS sent_id, CAST(i - 1 AS INTEGER) AS sent_num,
         string_split_regex(trim(lines[i]), '\s+') AS tokens, lines[i] AS sentence
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents))),
""",
)


@query(
    "c11_salient_events_documents",
    f"WITH {_DOCUMENT_SQL}{_SALIENT} SELECT doc_id, sent_id, doc_tok_idx, kind, token, lemma, score, ranking, total_pred FROM top",
)
def c11_salient_events_documents(spark, sf_dir):
    return salient_events(corpus_from_lines(texts(spark, sf_dir, "documents"), "doc_id", "text"))
