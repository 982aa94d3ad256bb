"""Corpus, annotation and result files (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove import schemas
from eventgrove.operators.prompts import flatten_ace, flatten_maven, flatten_rams


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Sentences with ``sent_num``, the last part of ``sent_id``."""
    rows = spark.read.schema(schemas.CORPUS).json(path)
    return rows.withColumn("sent_num", F.substring_index("sent_id", "-", -1).try_cast("int"))


def read_frames(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Frames of one annotator (``verb``, ``nom`` or ``prep``) in the common frame schema."""
    none = F.lit(None).cast("string")

    def frame(text, indices, predicate_index, sense, f):
        return F.struct(
            F.lit(kind).alias("kind"),
            text.alias("text"),
            indices.alias("indices"),
            predicate_index.alias("predicate_index"),
            sense.alias("sense"),
            f["description"].alias("description"),
            f["tags"].alias("tags"),
        )

    if kind == "verb":
        rows = spark.read.schema(schemas.VERB_WIRE).json(path)
        frames = F.transform(
            "verbs", lambda f: frame(f["verb"], F.array(f["verb_index"]), f["predicate_index"], f["sense"], f)
        )
    elif kind == "nom":
        rows = spark.read.schema(schemas.NOMINAL_WIRE).json(path)
        frames = F.transform(
            "nominals", lambda f: frame(f["nominal"], f["nominal_indices"], f["predicate_index"], f["sense"], f)
        )
    elif kind == "prep":
        rows = spark.read.schema(schemas.PREPOSITION_WIRE).json(path)
        frames = F.transform(
            "prepositions", lambda f: frame(f["preposition"], f["predicate_index"], f["predicate_index"], none, f)
        )
    else:
        raise ValueError(f"unknown kind {kind!r}")
    empty = F.array().cast(f"array<{schemas.FRAME}>")
    return rows.select("sent_id", "words", F.coalesce(frames.cast(f"array<{schemas.FRAME}>"), empty).alias("frames"))


def read_indicator(spark: SparkSession, path: str) -> DataFrame:
    """Nominal indicator lines (sent_id, words, nominals)."""
    return spark.read.schema("sent_id string, words array<string>, nominals array<int>").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORES_WIRE).json(path)


def write_event_types(result: DataFrame, path: str) -> None:
    """One JSON object per sentence, in corpus order, sentences without events included."""
    result.orderBy("doc_id", "sent_num").select("doc_id", "sent_id", "tokens", "sentence", "predictions").write.json(path)


def read_event_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.CORPUS}, predictions array<{schemas.PREDICTION}>").json(path)


def read_event_dataset(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(sentence, event_type, trigger) from the three labelled layouts."""
    if dataset == "ace2005":
        return flatten_ace(spark.read.schema(schemas.ACE_WIRE).json(path))
    if dataset == "maven":
        return flatten_maven(spark.read.schema(schemas.MAVEN_WIRE).json(path))
    if dataset == "rams":
        return flatten_rams(spark.read.schema(schemas.RAMS_WIRE).json(path))
    raise ValueError(f"unknown dataset {dataset!r}")
