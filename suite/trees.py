"""Known tree: root -> region -> nation -> customer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgrove.plans.scratch import freeze
from suite.base import table

# Inner ids lie above all customers, in scrambled order: the root is not the largest.
GEO_SQL = """
size AS (SELECT count(*) AS n FROM customer),
geo AS (
  SELECT CAST(c_custkey AS BIGINT) AS child, CAST(n * 2 + 100 - c_nationkey AS BIGINT) AS parent, 0 AS label FROM customer, size
  UNION ALL
  SELECT CAST(n * 2 + 100 - n_nationkey AS BIGINT), CAST(n * 3 + 200 + n_regionkey AS BIGINT), NULL FROM nation, size
  UNION ALL
  SELECT CAST(n * 3 + 200 + r_regionkey AS BIGINT), CAST(n + 7 AS BIGINT), NULL FROM region, size
  UNION ALL
  SELECT CAST(n + 7 AS BIGINT), NULL, NULL FROM size)
"""


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    n = customer.count()
    edge = lambda df, child, parent, label: df.select(
        child.cast("bigint").alias("child"), parent.cast("bigint").alias("parent"), F.lit(label).cast("int").alias("label")
    )
    nation_id = lambda key: F.lit(n * 2 + 100) - F.col(key)
    region_id = lambda key: F.lit(n * 3 + 200) + F.col(key)
    root = spark.range(1).select(F.lit(n + 7).alias("id"))
    edges = reduce(
        DataFrame.unionByName,
        [
            edge(customer, F.col("c_custkey"), nation_id("c_nationkey"), 0),
            edge(table(spark, sf_dir, "nation"), nation_id("n_nationkey"), region_id("n_regionkey"), None),
            edge(table(spark, sf_dir, "region"), region_id("r_regionkey"), F.lit(n + 7), None),
            edge(root, F.col("id"), F.lit(None), None),
        ],
    )
    # As a tree comes from a stage table.
    return freeze(edges, "geography")
