"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch of a metric is a table of counts per bin. Bins keep the ten leading bits of the integer metric,
so a quantile is exact below 1,024 and within 1/512 above, whatever the number of rows. Sketches merge
by adding counts: those of the sources of a language give the language's sketch, and those of all
languages the corpus sketch. The result depends on the rows alone, not on their order or partitions,
so a task that runs again gives the same thresholds. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventgrove.functions.let import let
from eventgrove.plans.scratch import freeze

BLANK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
WINDOW = 3
#: Cells with fewer documents use the sketch of their language, and languages with fewer that of the corpus.
MIN_CELL_DOCS = 100


@dataclass(frozen=True)
class Fence:
    """Bounds of a metric from two quantiles (percent) of a sketch: ``spread`` times their distance beyond them.

    The upper one is high + spread * (high - low); with ``two_sided`` there is also low - spread * (high - low).
    """

    metric: str
    low: int
    high: int
    spread: int
    two_sided: bool = False


#: The shares are 0 for most documents, so their quantiles lie high; that of symbols lies lower, as junk may
#: be one document in twelve.
FENCES = (
    Fence("symbol_share", 50, 90, 3),
    Fence("dup_line_share", 50, 99, 1),
    Fence("repeat_share", 50, 99, 1),
    Fence("word_length", 25, 75, 6, two_sided=True),
)


def repeated_window_words(words: Column) -> Column:
    """Number of words inside windows of three words that occur twice or more in the array."""

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(rows: Column) -> Column:
            same = lambda row, k: (F.get(rows, k)["h"] == row["h"])
            again = F.filter(rows, lambda row, k: F.coalesce(same(row, k - 1), F.lit(False)) | F.coalesce(same(row, k + 1), F.lit(False)))
            return let(
                F.sort_array(F.transform(again, lambda row: row["i"])),
                body=lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                    F.lit(0).cast("bigint"),
                    lambda total, x: total + x.cast("bigint"),
                ),
            )

        # Sorting plain numbers is cheap; rows are sorted only where a number is found twice.
        twice = let(F.sort_array(hashes), body=lambda s: F.exists(F.transform(s, lambda h, k: F.coalesce(F.get(s, k - 1) == h, F.lit(False))), lambda x: x))
        return F.when(twice, let(placed, body=covered)).otherwise(F.lit(0).cast("bigint"))

    at = lambda i: F.get(words, i)
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    return F.when(F.size(words) > WINDOW, let(windows, body=count)).otherwise(F.lit(0).cast("bigint"))


def document_counts(text: Column) -> Column:
    """Struct of the base counts of one text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, BLANK), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD_CHAR))
    return let(
        words,
        lines,
        F.regexp_count(whole, F.lit(SYMBOL)),
        body=lambda w, l, symbols: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"),
            F.size(l).cast("bigint").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )


def ratio(part: str, whole: str, scale: int) -> Column:
    return F.expr(f"({scale} * {part}) div greatest({whole}, 1)")


def bin_of(value: Column) -> Column:
    """The value with all but its ten leading bits cleared."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 10)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bin, n): the mergeable sketches of the rows that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(f.metric).alias("metric"), F.col(f.metric).alias("value")) for f in FENCES))
    rows = metrics.where(~F.col("base_failed")).select(*keys, F.explode(pairs).alias("m"))
    return rows.groupBy(*keys, F.col("m.metric").alias("metric"), bin_of(F.col("m.value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser keys: counts add up."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, docs, low, high): the two quantiles of each fence. A window holds the bins of one sketch, some thousands at most."""
    of = Window.partitionBy(*keys, "metric")
    counted = sketch.withColumn("docs", F.sum("n").over(of)).withColumn("upto", F.sum("n").over(of.orderBy("bin")))
    percent = lambda side: reduce(lambda out, f: out.when(F.col("metric") == f.metric, getattr(f, side)), FENCES, F)
    reached = lambda side: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * percent(side), F.col("bin"))).alias(side)
    return counted.groupBy(*keys, "metric").agg(F.first("docs").alias("docs"), reached("low"), reached("high"))


def bounds(quantile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, docs, low_<metric>, high_<metric>): one row for each cell."""
    columns = [F.max("docs").alias("docs")]
    for f in FENCES:
        mine = lambda c, m=f.metric: F.max(F.when(F.col("metric") == m, F.col(c)))
        slack = (mine("high") - mine("low")) * f.spread
        least = mine("low") - slack if f.two_sided else F.lit(0).cast("bigint")
        columns += [least.alias(f"low_{f.metric}"), (mine("high") + slack).alias(f"high_{f.metric}")]
    return quantile.groupBy(*keys).agg(*columns)


def quality_rules(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``df``: id, language, source, base counts, metrics, bounds, ``base_failed`` and ``kept``.

    * Null texts count as empty: no words, so they fail the base rule. Null languages and sources are cells
      of their own. Repeated rows are judged and counted one by one. Other columns are not looked at.
    * A cell with fewer than MIN_CELL_DOCS passing documents takes the bounds of its language, a language
      with fewer those of the corpus. An empty table gives an empty result.
    * The counts are frozen once; sketches and verdicts both start from that narrow table.
    """
    spark = df.sparkSession
    base = df.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), document_counts(F.col(text)).alias("c"))
    base = freeze(base.select("id", "lang", "source", "c.*"), "quality")
    metrics = base.select(
        "*",
        ratio("n_symbols", "word_chars", 10_000).alias("symbol_share"),
        ratio("n_dup_lines", "n_lines", 10_000).alias("dup_line_share"),
        ratio("n_repeat_words", "n_words", 10_000).alias("repeat_share"),
        ratio("word_chars", "n_words", 100).alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"),
    )
    cell = freeze(sketches(metrics, ["lang", "source"]), "sketch")
    language = merged(cell, ["lang"])
    levels = [
        (bounds(quantiles(cell, ["lang", "source"]), ["lang", "source"]), ["lang", "source"], "cell"),
        (bounds(quantiles(language, ["lang"]), ["lang"]), ["lang"], "lang"),
        (bounds(quantiles(merged(language, []), []), []), [], "all"),
    ]
    cells = metrics.select("lang", "source").distinct()
    for level, keys, name in levels:
        packed = level.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*(c for c in level.columns if c not in keys)).alias(f"{name}_bounds"))
        if keys:
            match = reduce(and_, (cells[k].eqNullSafe(packed[f"{name}_{k}"]) for k in keys))
            cells = cells.join(packed, match, "left").drop(*(f"{name}_{k}" for k in keys))
        else:  # one row
            cells = cells.join(F.broadcast(packed), F.lit(True), "left")
    enough = lambda name: F.coalesce(F.col(f"{name}_bounds.docs") >= MIN_CELL_DOCS, F.lit(False))
    names = [n for f in FENCES for n in (f"low_{f.metric}", f"high_{f.metric}")]
    limits = cells.select(
        F.col("lang").alias("cell_lang"),
        F.col("source").alias("cell_source"),
        *(F.when(enough("cell"), F.col(f"cell_bounds.{n}")).when(enough("lang"), F.col(f"lang_bounds.{n}")).otherwise(F.col(f"all_bounds.{n}")).alias(n) for n in names),
    )
    joined = metrics.join(limits, F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("source").eqNullSafe(F.col("cell_source")), "left")
    inside = reduce(and_, (F.col(f.metric).between(F.col(f"low_{f.metric}"), F.col(f"high_{f.metric}")) for f in FENCES))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(*metrics.columns, *names, kept.alias("kept"))
