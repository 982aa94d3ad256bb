"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.llm.registry import query, table
from eventgrove.llm.topk import top_k

TOP_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_top_k", TOP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every fiftieth one."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
