"""Queries that read documents or pages one by one: pieces, main texts, languages and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.llm.extraction import extract_main_text
from eventgrove.llm.langid import fold, learn_profiles, predict_language
from eventgrove.llm.pieces import load_model, round_trip_pieces
from eventgrove.llm.quality import quality_rules
from eventgrove.llm.registry import query, table


def piece_model_path() -> str:
    """The public 32k model; another file can be given to ``op1`` as ``model_path``."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    model = load_model(model_path or piece_model_path())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip_pieces(docs, model, keep=["doc_id"])
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fold 1 is held out of the training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id")) == 1).alias("held_out"))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return predict_language(docs, profiles, keep=["doc_id", "held_out"])


QUALITY_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM doc),
win AS (
  SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM cut)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM win JOIN twice USING (r, g)) GROUP BY r),
base AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN rep USING (r)),
met AS (
  SELECT *, 10000 * n_symbols // greatest(word_chars, 1) AS symbol_share, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
         10000 * n_repeat_words // greatest(n_words, 1) AS repeat_share, 100 * word_chars // greatest(n_words, 1) AS word_length,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM base),
long AS (
  UNPIVOT (SELECT lang, source, symbol_share, dup_line_share, repeat_share, word_length FROM met WHERE NOT base_failed)
  ON symbol_share, dup_line_share, repeat_share, word_length INTO NAME metric VALUE v),
binned AS (
  SELECT lang, source, metric, (v >> greatest(0, length(ltrim(bin(v), '0')) - 10)) << greatest(0, length(ltrim(bin(v), '0')) - 10) AS bin FROM long),
lvl AS (
  SELECT 'cell' AS level, lang, source, metric, bin, count(*) AS n FROM binned GROUP BY ALL
  UNION ALL SELECT 'lang', lang, NULL, metric, bin, count(*) FROM binned GROUP BY ALL
  UNION ALL SELECT 'all', NULL, NULL, metric, bin, count(*) FROM binned GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER w AS docs, sum(n) OVER (w ORDER BY bin) AS upto FROM lvl WINDOW w AS (PARTITION BY level, lang, source, metric)),
qs AS (
  SELECT level, lang, source, metric, max(docs) AS docs, min(bin) FILTER (upto * 100 >= docs * CASE metric WHEN 'word_length' THEN 25 ELSE 50 END) AS a,
         min(bin) FILTER (upto * 100 >= docs * CASE metric WHEN 'word_length' THEN 75 WHEN 'symbol_share' THEN 90 ELSE 99 END) AS b
  FROM cum GROUP BY ALL),
fence AS (
  SELECT *, CASE metric WHEN 'word_length' THEN a - 6 * (b - a) ELSE 0 END AS low,
         b + (b - a) * CASE metric WHEN 'word_length' THEN 6 WHEN 'symbol_share' THEN 3 ELSE 1 END AS high
  FROM qs WHERE docs >= 100 OR level = 'all'),
pick AS (
  SELECT DISTINCT m.lang, m.source, f.metric,
         first_value(f.low) OVER (PARTITION BY m.lang, m.source, f.metric ORDER BY array_position(['cell', 'lang', 'all'], f.level)) AS low,
         first_value(f.high) OVER (PARTITION BY m.lang, m.source, f.metric ORDER BY array_position(['cell', 'lang', 'all'], f.level)) AS high
  FROM (SELECT DISTINCT lang, source FROM met) m
  JOIN fence f ON f.level = 'all' OR (f.lang IS NOT DISTINCT FROM m.lang AND (f.level = 'lang' OR f.source IS NOT DISTINCT FROM m.source)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND symbol_share BETWEEN a.low AND a.high AND dup_line_share BETWEEN b.low AND b.high
                AND repeat_share BETWEEN c.low AND c.high AND word_length BETWEEN d.low AND d.high, false) AS kept
FROM met m
LEFT JOIN pick a ON a.metric = 'symbol_share' AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
LEFT JOIN pick b ON b.metric = 'dup_line_share' AND b.lang IS NOT DISTINCT FROM m.lang AND b.source IS NOT DISTINCT FROM m.source
LEFT JOIN pick c ON c.metric = 'repeat_share' AND c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source
LEFT JOIN pick d ON d.metric = 'word_length' AND d.lang IS NOT DISTINCT FROM m.lang AND d.source IS NOT DISTINCT FROM m.source
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
