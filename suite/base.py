"""Registry, table access and the shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.functions.tokens import default_lemma, token_form
from eventgrove.operators.corpus import corpus_from_table
from eventgrove.operators.mentions import annotate_sentences, assemble_documents, mentions_of
from eventgrove.plans.scratch import TASKS_PER_CORE, freeze, use_all_cores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with text, on which the work per row is large."""
    return use_all_cores(table(spark, sf_dir, name))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(use_all_cores(table(spark, sf_dir, "conversations"), TASKS_PER_CORE), "conv_id", "turn", "text")


def conversation_mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(annotated sentences, mentions with document positions)."""
    annotated = freeze(annotate_sentences(conversations(spark, sf_dir)), "annotated")
    return annotated, assemble_documents(annotated, mentions_of(annotated))


def joined(column, sep: str = " "):
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), sep)


def benchmark_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (form, lemma) of the words in ``benchmark``."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.trim("text"), r"\s+")).alias("token"))
    form = token_form(F.col("token"))
    return words.select(form.alias("form"), default_lemma(form).alias("lemma")).where("form != ''").distinct()


# Sentences, tokens and rule mentions of ``conversations``.
CORPUS_SQL = r"""
corpus AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id || '-' || turn AS sent_id, CAST(turn AS INTEGER) AS sent_num,
         string_split_regex(trim(text), '\s+') AS tokens, text AS sentence
  FROM conversations),
tok AS (
  SELECT doc_id, sent_id, sent_num, CAST(i - 1 AS INTEGER) AS tok_idx, tokens[i] AS token, CAST(len(tokens) AS INTEGER) AS n_tokens
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM corpus)),
form AS (SELECT *, regexp_replace(lower(token), '[^\p{L}]+$', '') AS form FROM tok),
tagged AS (
  SELECT *, CASE WHEN regexp_matches(form, '(ed|ing|er)$') THEN 'verb' WHEN regexp_matches(form, '(tion|ment)$') THEN 'nom' END AS kind,
         regexp_replace(form, '^(.+?)(ed|ing|er|tion|ment)$', '\1') AS lemma
  FROM form),
mention AS (SELECT * FROM tagged WHERE kind IS NOT NULL),
offs AS (
  SELECT doc_id, sent_id, sent_num, CAST(coalesce(sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY sent_num
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_offset
  FROM corpus),
placed AS (SELECT m.*, o.sent_offset, o.sent_offset + m.tok_idx AS doc_tok_idx FROM mention m JOIN offs o USING (sent_id)),
ndocs AS (SELECT count(DISTINCT doc_id) AS n FROM corpus),
tf AS (SELECT doc_id, lemma, count(*) AS tf FROM mention GROUP BY ALL),
df AS (SELECT lemma, count(*) AS df FROM tf GROUP BY ALL),
weight AS (SELECT doc_id, lemma, tf, df, round(tf * ln((CAST(n AS DOUBLE) + 1) / (df + 1)), 9) AS score FROM tf JOIN df USING (lemma), ndocs),
scored AS (SELECT p.*, w.score FROM placed p JOIN weight w USING (doc_id, lemma)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, doc_tok_idx, kind) - 1 AS ranking,
         count(*) OVER (PARTITION BY doc_id) AS total_pred
  FROM scored)
"""

# Rule frames: one tag row per mention and token.
FRAME_SQL = (
    CORPUS_SQL
    + r""",
frame AS (SELECT *, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY tok_idx) - 1 AS INTEGER) AS frame FROM mention),
tag AS (
  SELECT f.sent_id, f.frame, f.kind, f.token AS predicate, f.tok_idx AS "at", t.tok_idx, t.token,
         CASE WHEN t.tok_idx = f.tok_idx - 1 THEN 'B-ARG0' WHEN t.tok_idx = f.tok_idx THEN 'B-V'
              WHEN t.tok_idx = f.tok_idx + 1 THEN 'B-ARG1' WHEN t.tok_idx = f.tok_idx + 2 THEN 'I-ARG1' ELSE 'O' END AS tag
  FROM frame f JOIN tok t USING (sent_id)),
span AS (
  SELECT sent_id, frame, kind, tok_idx AS "at", unnest([
    {'label': 'ARG0', 'start': tok_idx - 1, 'end': tok_idx},
    {'label': 'V', 'start': tok_idx, 'end': tok_idx + 1},
    {'label': 'ARG1', 'start': tok_idx + 1, 'end': least(tok_idx + 3, n_tokens)}], recursive := true)
  FROM frame),
spans AS (SELECT * FROM span WHERE "start" >= 0 AND "start" < "end")
"""
)
