"""Row numbers, ranks and running sums that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventgrove.plans.scratch import freeze

POSITIONS_PER_PIECE = 4096


def dense_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows 0..n-1 in ``order``.

    One range shuffle sorts the rows; their slot (partition, row in partition) is frozen, so the
    partition sizes and the rows that use them come from the same sort. Only the partition sizes,
    one row per task of the sort, reach the driver.
    """
    spark = df.sparkSession
    slots = freeze(df.sort(*order).withColumn("_slot", F.monotonically_increasing_id()), "sorted")
    piece = F.shiftright("_slot", 33)
    sizes = slots.groupBy(piece.alias("_piece")).count().sort("_piece").collect()
    bases, total = [], 0
    for row in sizes:
        bases.append((row["_piece"], total))
        total += row["count"]
    base_table = spark.createDataFrame(bases, "_piece bigint, _base bigint")
    position = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        slots.withColumn("_piece", piece)
        .join(F.broadcast(base_table), "_piece")
        .withColumn(name, F.col("_base") + position)
        .drop("_piece", "_base", "_slot")
    )


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str, total: str) -> DataFrame:
    """0-based rank of each row in its group, and the group size.

    A rank is a global position minus the position of the group's first row. The sort spreads a
    hot group over many tasks, which ``Window.partitionBy(group)`` would not.
    """
    keys = [F.col(name) for name in group]
    placed = dense_index(df, [*keys, *order], "_position")
    bounds = placed.groupBy(*group).agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias(total))
    return (
        placed.join(bounds, list(group))
        .withColumn(rank, F.col("_position") - F.col("_first"))
        .drop("_position", "_first")
    )


def group_running_sum(
    df: DataFrame, group: Sequence[str], position: str, value: Column, name: str, per_piece: int = POSITIONS_PER_PIECE
) -> DataFrame:
    """Sum of ``value`` over the earlier positions of the group (exclusive).

    Positions are cut into pieces of ``per_piece``; each window holds one piece, and a second,
    ``per_piece`` times smaller window adds up the pieces of a group.
    """
    cut = df.withColumn("_piece", F.floor(F.col(position) / per_piece)).withColumn("_value", value.cast("bigint"))
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_piece").agg(F.sum("_value").alias("_total"))
    bases = totals.select(
        *group,
        "_piece",
        F.coalesce(F.sum("_total").over(before(Window.partitionBy(*group).orderBy("_piece"))), F.lit(0)).alias("_base"),
    )
    local = F.coalesce(
        F.sum("_value").over(before(Window.partitionBy(*group, "_piece").orderBy(position))), F.lit(0)
    )
    return (
        cut.withColumn("_local", local)
        .join(bases, [*group, "_piece"])
        .withColumn(name, F.col("_base") + F.col("_local"))
        .drop("_piece", "_value", "_local", "_base")
    )
