"""Connected components of a table of links, by repeated hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.plans.scratch import freeze


def followed(pointers: DataFrame) -> DataFrame:
    """(node, root) from (node, root) where a root may itself point further: jump until nothing changes."""
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = freeze(pointers.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jump")
        pointers = stepped.select("node", "root")
        if not stepped.where("moved").limit(1).count():
            return pointers


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not the smallest of its component.

    In each round every node points to its smallest neighbour, pointers are followed to their ends, and
    the links between the ends go on. Minima are taken before the shuffle, so a node with many links is no
    large group. Only the emptiness of a table reaches the driver.
    """
    spark = links.sparkSession
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = freeze(down, "links")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    first = True
    while left.limit(1).count():
        pointers = followed(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        if first:
            roots, first = pointers, False
        else:
            ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = roots.select("node")
            moved = roots.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = freeze(moved.unionByName(pointers.join(known, "node", "left_anti")), "roots")
        to_a = pointers.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        to_b = pointers.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        ends = left.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        left = freeze(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return roots
