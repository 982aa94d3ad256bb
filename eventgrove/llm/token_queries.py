"""Queries of token files, conversation repair and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.llm.byte_pieces import load_tokenizer
from eventgrove.llm.conversations import conversation_digests, damage_conversations, repair_conversations
from eventgrove.llm.registry import query, table
from eventgrove.llm.resample import ResamplePlan, resample
from eventgrove.llm.token_files import read_token_files, token_folder, write_token_files

END_ID = 2


def byte_tokenizer_path() -> str:
    """The public 50k tokenizer; another file can be given to ``op11`` as ``tokenizer_path``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Place, length and digest of every document's ids, from the token files written of ``documents``."""
    folder = token_folder(spark)
    files = write_token_files(table(spark, sf_dir, "documents"), folder, load_tokenizer(tokenizer_path or byte_tokenizer_path()), END_ID)
    return read_token_files(files, folder)


def _crc_sql(text: str) -> str:
    """CRC-32 of a text, from the table ``tab.t``: one step a byte."""
    byte = f"('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT"
    steps = f"list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({text}) + 1), lambda i: {byte})), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))"
    return f"xor({steps}, 4294967295)"


#: The table of CRC-32, by its rule.
CRC_TABLE_SQL = """step AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8)"""


def _more(way: str, cost: str, letter: str) -> str:
    """A way (nine digits of cost, then the audit; X if there is none) with one more edit."""
    return f"CASE WHEN {way} = 'X' THEN 'X' ELSE printf('%09d', substr({way}, 1, 9)::INTEGER + {cost}) || substr({way}, 10) || {letter} END"


def _repair_sql() -> str:
    keep = lambda way, x: _more(way, f"(CASE WHEN lower(c[1]) = '{x}' THEN 0 ELSE 1 END + CASE WHEN c[1] IN ('S', 'U', 'A', '!') THEN 5 ELSE 0 END)", f"CASE WHEN lower(c[1]) = '{x}' THEN 'K' ELSE 'R' END")
    sound = lambda value: f"CASE WHEN c[1] IN ('0', '1', '2', '3') THEN 'X' ELSE {value} END"
    # Ways that end at the start, behind system, behind user, behind assistant.
    read = ", ".join(
        [
            _more("w[1]", "2", "'D'"),
            f"least({_more('w[2]', '2', chr(39) + 'D' + chr(39))}, CASE WHEN c[1] IN ('s', 'S') THEN {keep('w[1]', 's')} ELSE 'X' END)",
            f"least({_more('w[3]', '2', chr(39) + 'D' + chr(39))}, {sound(keep('least(w[1], w[2], w[4])', 'u'))})",
            f"least({_more('w[4]', '2', chr(39) + 'D' + chr(39))}, {sound(keep('w[3]', 'a'))})",
        ]
    )
    to_user = f"list_transform([[{read}]], lambda v: [v[1], v[2], least(v[3], {_more('least(v[1], v[2], v[4])', '5', chr(39) + 'I' + chr(39))}), v[4]])"
    to_both = f"list_transform({to_user}, lambda v: [v[1], v[2], v[3], least(v[4], {_more('v[3]', '5', chr(39) + 'I' + chr(39))})])[1]"
    return rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
fated AS (SELECT conv_id, turn, role, text, {_crc_sql("name")} % 20 AS fate FROM named, tab),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0),
seen AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
coded AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS kind,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM seen),
conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list([substr(CASE WHEN fault IN ('blank', 'duplicate') THEN '0123' WHEN fault = 'truncated' THEN 'SUA!' ELSE 'sua?' END, kind, 1)] ORDER BY pos) AS codes
  FROM coded GROUP BY conv_id),
ways AS (
  SELECT * EXCLUDE (codes), list_reduce(list_prepend(['000000000', 'X', '000000005I', '000000010II'], codes), lambda w, c: {to_both}) AS w FROM conv),
best AS (SELECT * EXCLUDE (w), substr(least(w[1], w[4]), 1, 9)::BIGINT AS cost, substr(least(w[1], w[4]), 10) AS audit FROM ways),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
rowed AS (
  SELECT conv_id, p, substr(audit, CAST(p AS BIGINT), 1) AS letter, CAST(p AS BIGINT) - length(replace(left(audit, CAST(p AS BIGINT)), 'I', '')) AS inserted FROM letters),
stays AS (
  SELECT r.conv_id, r.p, r.letter, c.role, c.text, row_number() OVER (PARTITION BY r.conv_id ORDER BY r.p) AS k
  FROM rowed r LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.pos = r.p - r.inserted AND r.letter <> 'I' WHERE r.letter <> 'D'),
headed AS (SELECT *, max(CASE WHEN k = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM stays),
lines AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                                    || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM headed GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op12_conversation_repair", _repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation, after damage by the rule."""
    turns = table(spark, sf_dir, "conversations")
    repair = repair_conversations(damage_conversations(turns))
    digests = conversation_digests(repair.rows)
    found = repair.report.withColumnRenamed("conv_id", "_id").join(digests, "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
    return (
        turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
        .select("conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
    )


RESAMPLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bench AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM doc),
bw AS (SELECT unnest(ws) AS w FROM bench),
word AS (
  SELECT w, {_crc_sql("w")} % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN word USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN word USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
heavy AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN word USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN heavy USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""


@query("op13_target_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards ``benchmark``."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ResamplePlan(), keep=["doc_id"])
    return drawn.select("row.doc_id", "draw.n_features", "draw.weight", "draw.score", "draw.rank")
