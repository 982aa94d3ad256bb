"""Annotated text formats: span lines, preposition lines, CoNLL columns and ontology text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.functions import tags as tg
from eventgrove.functions.let import let, unpacked
from eventgrove.functions.tokens import positions_where
from eventgrove.operators.spans import parse_arguments
from eventgrove.sources.blocks import SPLIT_BYTES, register

BAR = "|||"
# Section markers and prefix of the ontology text.
ONTOLOGY_START = "# Event types"
ONTOLOGY_END = "# Event argument types"
ONTOLOGY_PREFIX = "ldcOnt:"


def _line_parts(lines: DataFrame) -> DataFrame:
    """(_parts, _bar) of each line. Filters on what is made of the parts stay behind the generator, so a line is cut once."""
    parts = F.array(F.split(F.trim("value"), r"\s+"))
    return unpacked(lines, [], parts, "_parts").withColumn("_bar", F.array_position("_parts", BAR).cast("int"))


def parse_span_lines(lines: DataFrame) -> DataFrame:
    """``file sentnum tok ... ||| sense s:e-LABEL ...`` to file, sentnum, tokens, sense, args, arguments."""
    return (
        _line_parts(lines)
        .where("_bar > 2")
        .select(
            F.get("_parts", F.lit(0)).alias("file"),
            F.get("_parts", F.lit(1)).cast("int").alias("sentnum"),
            F.slice("_parts", 3, F.col("_bar") - 3).alias("tokens"),
            F.get("_parts", F.col("_bar")).alias("sense"),
            F.slice("_parts", F.col("_bar") + 2, F.size("_parts")).alias("args"),
        )
        .withColumn("arguments", parse_arguments(F.col("args")))
    )


def read_span_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_span_lines(spark.read.text(path))


def predicates_by_sentence(lines: DataFrame) -> DataFrame:
    """(file, sentnum, tokens, predicates): the first argument of every line of a sentence, as (word, part)."""
    first = F.get(F.get("arguments", F.lit(0))["pieces"], F.lit(0))
    place = F.struct(first["start"].alias("word"), first["start_part"].alias("part"))
    return lines.groupBy("file", "sentnum").agg(
        F.min("tokens").alias("tokens"), F.sort_array(F.collect_set(place)).alias("predicates")
    )


def predicate_indicator(sentences: DataFrame) -> DataFrame:
    """1 on each predicate of the split sentence: on its part, or on the first piece of the whole word.

    A part that the split word does not have is left out. Needs ``new_tokens`` and ``new_indices``.
    """
    placed = let(
        F.col("new_indices"),
        body=lambda index_map: F.transform(
            "predicates", lambda p: F.get(F.get(index_map, p["word"]), F.coalesce(p["part"], F.lit(0)))
        ),
    )
    bits = lambda placed: F.transform(
        "new_tokens", lambda t, i: F.coalesce(F.array_contains(placed, i), F.lit(False)).cast("int")
    )
    return sentences.withColumn("indicator", let(placed, body=bits))


def parse_preposition_lines(lines: DataFrame) -> DataFrame:
    """``id tok ... ||| sense1 sense2 tag ...``; ``valid`` is false unless each token has a tag."""
    return (
        _line_parts(lines)
        .where("_bar > 1")
        .select(
            F.get("_parts", F.lit(0)).alias("id"),
            F.slice("_parts", 2, F.col("_bar") - 2).alias("tokens"),
            F.get("_parts", F.col("_bar")).alias("supersense1"),
            F.get("_parts", F.col("_bar") + 1).alias("supersense2"),
            F.slice("_parts", F.col("_bar") + 3, F.size("_parts")).alias("tags"),
        )
        .withColumn("indicator", F.transform("tags", lambda t: t.contains("PREP").cast("int")))
        .withColumn("valid", F.size("tags") == F.size("tokens"))
    )


def read_prep_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_preposition_lines(spark.read.text(path))


def parse_conll(blocks: DataFrame) -> DataFrame:
    """Text blocks (value, file) to one row per sentence; blank and ``#`` lines separate sentences."""
    chunks = F.split("value", r"(?m)^[ \t\r]*(?:#.*)?$")
    lines = lambda chunk: F.filter(F.split(chunk, r"[\r\n]+"), lambda line: F.trim(line) != "")
    rows = F.transform(lines(F.col("_chunk")), lambda line: F.split(F.trim(line), r"\s+"))
    # An array of one row: the filter on the rows stays behind it, so they are not cut a second time for it.
    sentences = unpacked(
        unpacked(blocks, ["file"], chunks, "_chunk").where(F.trim("_chunk") != ""), ["file"], F.array(rows), "rows"
    ).where(F.size("rows") > 0)
    column = lambda i: F.transform("rows", lambda r: F.get(r, F.lit(i)))
    or_null = lambda i: F.transform(column(i), lambda x: F.when(x != "-", x))
    width = F.size(F.get("rows", F.lit(0)))
    annotations = F.when(width > 8, F.sequence(F.lit(8), width - 1)).otherwise(F.array().cast("array<int>"))
    tags = let(
        F.col("rows"),
        body=lambda rows: F.transform(annotations, lambda c: tg.bracket_tags(F.transform(rows, lambda r: F.get(r, c)))),
    )
    is_predicate = lambda r: F.exists(F.slice(r, 9, F.size(r)), lambda cell: cell.contains("(V"))
    verbs = F.transform(F.filter("rows", is_predicate), lambda r: F.get(r, F.lit(3)))

    def frames(verbs: Column, tags: Column) -> Column:
        n = F.least(F.size(verbs), F.size(tags))
        return F.zip_with(
            F.slice(verbs, F.lit(1), n),
            F.slice(tags, F.lit(1), n),
            lambda v, t: F.struct(v.alias("predicate"), t.alias("tags")),
        )

    return sentences.select(
        "file",
        F.get(F.get("rows", F.lit(0)), F.lit(0)).alias("doc_id"),
        F.get(F.get("rows", F.lit(0)), F.lit(1)).cast("int").alias("part"),
        column(3).alias("words"),
        column(4).alias("pos"),
        or_null(6).alias("lemmas"),
        or_null(7).alias("framesets"),
        let(verbs, tags, body=frames).alias("frames"),
    )


def read_conll(spark: SparkSession, path: str, suffix: str = "gold_conll", domain: str | None = None) -> DataFrame:
    """All files below ``path`` that end in ``suffix``, of one domain folder if given.

    A record ends at a blank line, so large files split over tasks and no line order is needed.
    """
    blocks = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .option("lineSep", "\n\n")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    if domain:
        blocks = blocks.where(F.col("file").contains(f"/{domain}/"))
    return parse_conll(blocks)


def read_conll_blocks(spark: SparkSession, path: str, suffix: str = "gold_conll", domain: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``read_conll`` through the block source: files with CRLF split too, files of other domains are not opened."""
    register(spark)
    reader = spark.read.format("text_blocks").option("suffix", suffix).option("splitBytes", split_bytes)
    return parse_conll((reader.option("domain", domain) if domain else reader).load(path))


def conll_instances(sentences: DataFrame) -> DataFrame:
    """(tokens, indicator, tags) per frame; a sentence without frames gives one all-``O`` instance."""
    blank = F.array(F.struct(F.lit(None).cast("string").alias("predicate"), F.transform("words", lambda w: F.lit("O")).alias("tags")))
    frames = F.when(F.size("frames") > 0, F.col("frames")).otherwise(blank)
    return unpacked(sentences, ["words"], frames, "_f").select(
        F.col("words").alias("tokens"),
        F.transform("_f.tags", lambda t: t.endswith("-V").cast("int")).alias("indicator"),
        F.col("_f.tags").alias("tags"),
    )


def read_ontology_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) from an ontology text; an event path ends at its first ``n/a``."""
    text = spark.read.text(path, wholetext=True)
    after = F.split(F.substring_index("value", ONTOLOGY_END, 1), "\n")
    start = F.get(positions_where(after, lambda line: line.startswith(ONTOLOGY_START)), F.lit(0))
    lines = text.select(F.posexplode(after).alias("at", "line"), start.alias("start")).where("at > start")
    types = lines.where(F.col("line").startswith(ONTOLOGY_PREFIX)).select(
        F.split(F.get(F.split(F.substring("line", len(ONTOLOGY_PREFIX) + 1, 1 << 30), r"\s+"), F.lit(0)), r"\.").alias("path")
    )
    stop = F.get(positions_where(F.col("path"), lambda p: p == "n/a"), F.lit(0))
    known = F.slice("path", F.lit(1), F.coalesce(stop, F.size("path")))
    pairs = F.transform(
        F.slice(known, F.lit(2), F.size(known)), lambda c, i: F.struct(F.get(known, i).alias("parent"), c.alias("child"))
    )
    return types.select(F.inline(pairs)).distinct()
