"""Queries that weigh or label whole documents: mixing and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.llm.licence_texts import LICENCES, SPELLINGS
from eventgrove.llm.licences import LINE_START, NO_HOLDER, RESPELLED, STATED, scan_licences
from eventgrove.llm.mixing import MixPlan, mix_sources
from eventgrove.llm.registry import query, table

PLAN = MixPlan(
    weights={"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}},
    share=100,
    max_epochs=3,
    seed=17,
)


def domain_of(source: Column) -> Column:
    """Domain of a numbered source: three in turn, the rest is ``other``."""
    number = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    turn = F.when(number != "", number.cast("int") % 3)
    return F.when(turn == 0, "web").when(turn == 1, "books").when(turn == 2, "code").otherwise("other")


def _given(children: str, parent: str, budget: str, ties: str) -> str:
    """SQL of one level: the budget of each parent shared among its children."""
    of = f"PARTITION BY {parent}"
    return f"""
  SELECT *, CASE WHEN weight = 0 THEN 0 WHEN is_full THEN capacity
                 ELSE CAST(({budget} - coalesce(sum(CASE WHEN is_full THEN takes END) OVER ({of}), 0)) * weight
                      // greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({of}), 1) AS BIGINT) END AS given
  FROM (
    SELECT *, capacity * (sum(weight) OVER ({of}) - coalesce(sum(weight) OVER w, 0)) <= ({budget} - coalesce(sum(takes) OVER w, 0)) * weight AS is_full
    FROM (SELECT * REPLACE (CASE WHEN capacity > 0 THEN weight ELSE 0 END AS weight),
                 CASE WHEN capacity > 0 AND weight > 0 THEN capacity ELSE 0 END AS takes FROM ({children}))
    WINDOW w AS ({of} ORDER BY capacity / greatest(weight, 1), {ties} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


MIX_SQL = rf"""
WITH doc AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         CASE TRY_CAST(regexp_extract(source, '^src([0-9]{{1,9}})$', 1) AS INTEGER) % 3
              WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END AS domain
  FROM documents),
leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(3 * sum(n_tokens) AS BIGINT) AS capacity,
         CASE source WHEN 'src0' THEN 2 ELSE 1 END AS weight
  FROM doc GROUP BY ALL),
lng AS (
  SELECT domain, lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(capacity) AS BIGINT) AS capacity,
         CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight
  FROM leaf GROUP BY ALL),
dom AS (
  SELECT domain, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(capacity) AS BIGINT) AS capacity,
         CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight
  FROM lng GROUP BY ALL),
d AS ({_given("SELECT *, least(sum(tokens) OVER (), sum(capacity) OVER ()) AS target FROM dom", "1", "target", "domain")}),
l AS ({_given("SELECT lng.*, d.given AS parent FROM lng JOIN d USING (domain)", "domain", "parent", "domain, lang")}),
s AS ({_given("SELECT leaf.*, l.given AS parent FROM leaf JOIN l USING (domain, lang)", "domain, lang", "parent", "domain, lang, source")}),
b AS (SELECT domain, lang, source, given AS leaf_budget, given // greatest(tokens, 1) AS whole, given % greatest(tokens, 1) AS rest FROM s),
o AS (
  SELECT doc.*, leaf_budget, whole, rest,
         sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id), doc_id) AS upto
  FROM doc JOIN b USING (domain, lang, source))
SELECT doc_id, domain, n_tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o
"""


@query("op5_mix_sources", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, PLAN, domain_of(F.col("source")), keep=["doc_id"])
    return mixed.select("row.doc_id", "mix.domain", "mix.n_tokens", "mix.leaf_budget", "mix.copies")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stripped(text: str) -> str:
    """RE2 has no look-ahead: a line with a holder is one with a word behind "copyright" that is not one of running text."""
    before = rf"{LINE_START}copyright[ \t]+"
    states = rf"regexp_matches(l, '{LINE_START}{STATED}') OR regexp_matches(l, '{before}[\p{{L}}\[<{{]') AND NOT regexp_matches(l, '{before}(?:{NO_HOLDER})\b')"
    kept = f"array_to_string(list_transform(string_split(lower({text}), chr(10)), lambda l: CASE WHEN {states} THEN '' ELSE l END), chr(10))"
    return rf"regexp_replace(replace({kept}, '&', ' and '), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _respelled(text: str) -> str:
    for variant, usual in sorted(SPELLINGS.items()):
        text = rf"regexp_replace({text}, '\b{variant}\b', '{usual}', 'g')"
    return text


LICENCE_SQL = rf"""
WITH known AS (
  SELECT md5({_respelled("form")}) AS known, min(licence) AS licence, min(length(form)) AS size
  FROM (SELECT licence, trim(regexp_replace({_stripped("text")}, '[ \n]+', ' ', 'g')) AS form
        FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(LICENCES.items()))}) AS v(licence, text))
  GROUP BY 1),
lim AS (SELECT greatest(1, min(size) // {RESPELLED}) AS lo, max(size) * {RESPELLED} AS hi FROM known),
form AS (SELECT row_number() OVER () AS r, doc_id, {_stripped("coalesce(text, '')")} AS form FROM documents),
whole AS (SELECT r, doc_id, trim(regexp_replace(form, '[ \n]+', ' ', 'g')) AS form FROM form),
line AS (
  SELECT DISTINCT r, form FROM (SELECT r, trim(unnest(string_split(form, chr(10)))) AS form FROM form), lim
  WHERE length(form) BETWEEN lo AND hi),
hit AS (
  SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM line JOIN known ON md5({_respelled("line.form")}) = known GROUP BY r),
dig AS (SELECT r, doc_id, md5({_respelled("form")}) AS digest FROM whole)
SELECT doc_id, digest, known.licence, coalesce(hit.notices, '') AS notices
FROM dig LEFT JOIN known ON digest = known LEFT JOIN hit USING (r)
"""


@query("op8_licence_scan", LICENCE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text licence and licence lines of every document."""
    return scan_licences(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "digest", "licence", "notices")
