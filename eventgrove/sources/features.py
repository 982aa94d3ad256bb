"""Tab-separated feature and tree files, and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove import schemas


def feature_lines(features: DataFrame) -> DataFrame:
    """``id \\t label \\t x1 ... xD`` text rows."""
    numbers = F.array_join(F.transform("features", lambda x: x.cast("string")), "\t")
    return features.select(F.concat_ws("\t", F.col("id"), F.col("label"), numbers).alias("value"))


def parse_feature_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    return lines.select(
        F.get(parts, F.lit(0)).cast("bigint").alias("id"),
        F.get(parts, F.lit(1)).cast("int").alias("label"),
        F.slice(parts, 3, F.size(parts) - 2).cast("array<float>").alias("features"),
    )


def write_features(features: DataFrame, path: str) -> None:
    feature_lines(features).write.text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return parse_feature_lines(spark.read.text(path))


def write_tree(edges: DataFrame, path: str) -> None:
    """``child \\t parent \\t label`` with the literal None for no parent and no label."""
    edges.select("child", "parent", "label").write.csv(path, sep="\t", nullValue="None")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EDGE).csv(path, sep="\t", nullValue="None")


def stage(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """The table at ``path``, computed from ``df`` unless a finished one is there.

    Finished means that the write's ``_SUCCESS`` marker exists, so a broken write is redone.
    """
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    finished = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if overwrite or not finished:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
