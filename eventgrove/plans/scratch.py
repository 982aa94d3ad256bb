"""Tables written between the steps of a job.

A frozen table cuts lineage and pins values that must not change between two reads (range
partition numbers, rounds of an iteration). It lives in the shared folder named by
``spark.checkpoint.dir``, so a lost executor costs a re-read and nothing more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tasks per core where a row makes many: with one each, the longest would last as long as the whole step.
TASKS_PER_CORE = 4

_local_dirs: dict[str, str] = {}
#: Paths given out so far, for ``temporary_tables``.
_given: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for frozen tables; a private one is made only for local masters without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-eventgrove-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables frozen inside are removed at the end, so a long job holds those of one step only.

    What is to stay must have been written by then, to a path from outside.
    """
    before = len(_given)
    try:
        yield
    finally:
        for name in _given[before:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _given[before:]


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_all_cores(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Spread a table that has fewer splits than there are cores, for row-local work that is slow per byte.

    A large table has more splits than that and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(per_core * cores) if df.rdd.getNumPartitions() < cores else df
