"""From raw documents to token ids: language, near copies, repeated passages, mix, pieces.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet to the shared
folder and reads it again for the next one. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.llm.jaccard import similar_documents
from eventgrove.llm.langid import UNKNOWN, fold, learn_profiles, predict_language
from eventgrove.llm.mix_queries import PLAN, domain_of
from eventgrove.llm.mixing import mix_sources
from eventgrove.llm.pieces import load_model, round_trip_pieces
from eventgrove.llm.suffix_dedup import strip_repeated_strings
from eventgrove.llm.text_queries import piece_model_path
from eventgrove.plans.ordering import dense_index
from eventgrove.plans.scratch import freeze, scratch_path, temporary_tables

#: The stages cannot be expressed in SQL; the tests compare them with brute force.
ORACLE_SQL = None

#: Bytes of the repeated strings that ``suffix_dedup`` cuts: less than 51 words hold, also of short words.
PASSAGE_BYTES = 240
#: Rows of one file, as a power of two.
ROW_BITS = 40


def unused(name: str, docs: DataFrame) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row that is the same at every reading, and that column's name.

    The number is made of the file and the place in it, so no text is copied for it. What is not a table of
    files is written as one first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = freeze(docs, "rows")
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["row_index"])
    except AnalysisException:
        docs = freeze(docs, "rows")
        place = docs.metadataColumn("_metadata")
    file, at, number, key = (unused(n, docs) for n in ("_file", "_at", "_number", "_row"))
    rows = docs.select("*", place["file_path"].alias(file), place["row_index"].alias(at))
    # Written, so that Spark knows its size and broadcasts it if that is small: no text is shuffled for the join then.
    files = freeze(dense_index(rows.select(file).distinct(), [F.col(file)], number), "files")
    keyed = rows.join(files, file).withColumn(key, F.shiftleft(number, ROW_BITS) + F.col(at))
    return keyed.select(*docs.columns, key), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which op6 gives a language. Only its ``und`` goes: a short clean text may have any cosine.

    Null, empty and letterless texts go; repeated rows share one prediction; an empty table stays empty.
    """
    profiles = learn_profiles(docs.where(fold(F.col("doc_id")) != 1))
    language = unused("_language", docs)
    known = predict_language(docs, profiles, predicted=language, score=unused("_cosine", docs))
    return known.where(F.col(language) != UNKNOWN).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows the one with the smallest id; null ids come last, equal ids in the order of the table.

    Groups are made of rows, not of ids: what else has the id of a copy stays. Null and empty texts are
    similar to nothing and stay.
    """
    numbered, key = with_row_key(docs)
    found = freeze(similar_documents(numbered, id=key).select(F.col("doc_id").alias("row"), "component_id"), "similar")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row"))
    ids = numbered.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    first = found.join(ids, "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    others = freeze(found.join(first, "row", "left_anti").select(F.col("row").alias(key)), "others")
    return numbered.join(others, key, "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE_BYTES`` that occur more than once; ``n_chars`` follows the text.

    A null text stays null; a text that is one repeated string becomes empty.
    """
    return strip_repeated_strings(docs, length=PASSAGE_BYTES).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null languages and sources are nodes of their own, null and empty texts come with every whole epoch,
    equal rows are interchangeable, an empty table stays empty.
    """
    rows, key = with_row_key(docs)
    mixed = mix_sources(rows, PLAN, domain_of(F.col("source")), keep=[key]).where(F.col("mix.copies") > 0)
    taken = mixed.select(F.col(f"row.{key}").alias("row"), F.col("mix.copies").alias("copies"))
    joined = rows.select(F.col(key).alias("row"), F.struct(*docs.columns).alias("doc")).join(taken, "row")
    each = joined.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return each.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the digest of the text that they decode to; a null text is empty."""
    coded = round_trip_pieces(docs, load_model(piece_model_path()), keep=["doc_id", "lang", "source"])
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("mix_sources", mix_to_weights),
    ("sentencepiece", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage froze for itself goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with temporary_tables(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
