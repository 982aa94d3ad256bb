"""Licence scans by canonical digest: whole texts are normalised, hashed and joined to known digests.

Normal form: lower case, copyright lines out, "&" as "and", everything but letters and digits as one
blank, equivalent spellings as one. A document is looked up as a whole, and so is each of its lines,
which finds one-line notices inside a longer document. The known digests come from a fixed table, so
their broadcast has a constant size. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgrove.functions.let import let
from eventgrove.llm.licence_texts import LICENCES, SPELLINGS

# Words behind "copyright" in running text, where no holder follows.
NO_HOLDER = (
    "and|are|as|at|disclaimers?|doctrines?|for|from|has|holders?|if|in|infringements?|interests?|is|laws?|licen[cs]es?|licensors?|may|notices?|of|on|or|"
    "owners?|ownership|permissions?|protect(?:ed|ions?)|resulting|rights?|shall|statements?|that|the (?:library|program|software|work)|this|to|treat(?:y|ies)|"
    "under|which|will|with"
)
#: A line that states a copyright: the word and a sign, year or holder, or a sign alone, and what follows on the line.
#: A wrapped line of a licence may begin with "copyright notice" or "(c) You must": it stays.
LINE_START = r"^[^\p{L}\p{N}\n(©_]*"
STATED = (
    r"(?:copyright[ \t:]*(?:\(c\)|©|[\[<{]*(?:\d|y{2,4}\b|year\b))"
    r"|\(c\)[ \t]*copyright|\(c\)[^\n]*(?:\b(?:19|20)\d\d\b|all rights reserved)|©|all rights reserved)"
)
COPYRIGHT_LINE = rf"(?md){LINE_START}(?:{STATED}|copyright[ \t]+(?!(?:{NO_HOLDER})\b)[\p{{L}}\[<{{])[^\n]*$"
#: A line this many times longer than the longest known text cannot become equal to it by respelling.
RESPELLED = 2


def stripped(text: Column) -> Column:
    """Lower case without copyright lines and punctuation; line breaks stay."""
    lower = F.lower(text)
    # Few documents have such a line; the others skip the slower pattern.
    without = F.when(lower.rlike("copyright|\\(c\\)|©|all rights"), F.regexp_replace(lower, COPYRIGHT_LINE, "")).otherwise(lower)
    return F.regexp_replace(F.replace(without, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")


def respelled(text: Column) -> Column:
    """One spelling for equivalent words; a text without any variant is returned as it is."""
    out = text
    for variant, usual in sorted(SPELLINGS.items()):
        out = F.regexp_replace(out, rf"\b{variant}\b", usual)
    return F.when(text.rlike(rf"\b(?:{'|'.join(sorted(SPELLINGS))})\b"), out).otherwise(text)


def digest(one_line: Column) -> Column:
    return F.md5(respelled(one_line).cast("binary"))


def joined_lines(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known_digests(df: DataFrame, licences: Mapping[str, str]) -> tuple[DataFrame, int, int]:
    """((digest, licence), shortest, longest normal form) of the given texts; equal normal forms share the smallest name."""
    spark = df.sparkSession
    texts = spark.createDataFrame(sorted(licences.items()), "licence string, text string")
    forms = texts.select("licence", joined_lines(stripped(F.col("text"))).alias("form"))
    known = forms.groupBy(digest(F.col("form")).alias("known")).agg(F.min("licence").alias("licence"), F.length(F.first("form")).alias("size"))
    rows = known.collect()  # one row per known licence
    table = spark.createDataFrame([(r["known"], r["licence"]) for r in rows], "known string, licence string")
    return table, min((r["size"] for r in rows), default=1), max((r["size"] for r in rows), default=0)


def scan_licences(df: DataFrame, id: str = "doc_id", text: str = "text", licences: Mapping[str, str] = LICENCES) -> DataFrame:
    """One row per row of ``df``: id, ``digest`` of the whole text, ``licence`` (null if unknown), ``notices``.

    ``notices`` has the sorted names of licences that one of the lines is, joined by commas; it is empty
    if none is. A null text counts as empty, and an empty normal form is no licence. Repeated rows are
    scanned one by one; other columns are not looked at; an empty table gives an empty result.
    """
    known, shortest, longest = known_digests(df, licences)
    short, long = max(1, shortest // RESPELLED), longest * RESPELLED
    possible = lambda form: F.length(form).between(short, long)
    unit = lambda form, whole: F.struct(F.lit(whole).alias("whole"), digest(form).alias("digest"))

    def units(form: Column) -> Column:
        lines = F.filter(F.transform(F.split(form, "\n"), lambda line: F.trim(line)), possible)
        whole = let(joined_lines(form), body=lambda f: unit(f, True))
        return F.concat(F.array(whole), F.transform(F.array_distinct(lines), lambda line: unit(line, False)))

    rows = df.select(F.monotonically_increasing_id().alias("at"), F.col(id).alias("id"), let(stripped(F.coalesce(F.col(text), F.lit(""))), body=units).alias("units"))
    # The outer explode keeps the array from being evaluated once more for its size.
    each = rows.select("at", "id", F.explode_outer("units").alias("unit")).select("at", "id", "unit.whole", "unit.digest")
    found = each.join(F.broadcast(known), each["digest"] == known["known"], "left").where(F.col("whole") | F.col("licence").isNotNull())
    return (
        found.groupBy("at")
        .agg(
            F.first("id").alias("id"),
            F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
            F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
            F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("notices"),
        )
        .drop("at")
    )
