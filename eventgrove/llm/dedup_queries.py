"""Queries on text that repeats across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.llm.anchors import key_columns
from eventgrove.llm.fm_dedup import repeated_word_windows
from eventgrove.llm.jaccard import similar_documents
from eventgrove.llm.registry import query, table
from eventgrove.llm.suffix_dedup import repeated_strings

WORD = r"[^\x20\x09-\x0D]+"


def with_changes(docs: DataFrame, facts: dict[str, Column], changes: DataFrame) -> DataFrame:
    """The documents' own facts beside what changed in them; narrow rows only."""
    k1, k2 = key_columns(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", k1, k2, *(c.alias(n) for n, c in facts.items()))
    changes = changes.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    return rows.join(changes, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")


def removed(starts: str, ends: str) -> Column:
    """Symbols in the removed stretches."""
    return F.aggregate(F.zip_with(ends, starts, lambda b, a: b - a), F.lit(0).cast("bigint"), lambda total, x: total + x)


WORDS_SQL = r"SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents"

WINDOWS_SQL = rf"""
WITH w AS MATERIALIZED ({WORDS_SQL.format(text="coalesce(text, '')")}),
win AS MATERIALIZED (
  SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (h)),
word AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

STRINGS_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS x FROM documents),
win AS MATERIALIZED (
  SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS fresh FROM win JOIN twice USING (h)),
run AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM run),
kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS x
  FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

LINKS_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED ({WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
sh AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT reach.a AS r, min(w.doc_id) AS m FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(m, doc_id), doc_id, m) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""


@query("op4_substring_dedup", WINDOWS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without the repeated windows of 35."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changes = repeated_word_windows(docs).select("k1", "k2", removed("starts", "ends").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    whole = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    out = with_changes(docs, {"n_words": words, "whole_sha256": F.sha2(whole.cast("binary"), 256)}, changes)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    )


@query("op7_suffix_array_dedup", STRINGS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without the repeated strings of 400."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changes = repeated_strings(docs).select(
        "k1", "k2", removed("starts", "ends").alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    data = F.coalesce("text", F.lit("")).cast("binary")
    out = with_changes(docs, {"n_bytes": F.octet_length(data).cast("bigint"), "whole_sha256": F.sha2(data, 256)}, changes)
    zero = F.lit(0).cast("bigint")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


@query("op9_ngram_jaccard_join", LINKS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return similar_documents(table(spark, sf_dir, "documents"))
