"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source. Capacities (tokens times the most epochs) add up from the leaves;
budgets go down from the root. At each node the budget is shared among the children by weight; a child
that cannot use its share passes the rest on to its siblings, and what no sibling can use has already
been left out of the parent's own budget, so that it went to the parent's siblings. A leaf then takes
whole epochs, and of the next epoch the longest prefix, in that epoch's seeded order, that fits.

All amounts are integers, so the result does not depend on partitions. The running sums of a leaf are
made of hash ranges of its order: sums within a range, and one small sum over ranges, so that no leaf
is one task, however many rows it holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventgrove.plans.scratch import freeze

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a leaf that one range of its order holds, about.
RANGE_ROWS = 4096


@dataclass(frozen=True)
class MixPlan:
    """Parameters of a mix.

    ``weights`` has integer weights from 0 to 10,000 by level and node name; names that are not listed
    weigh 1. ``share`` (percent) times the corpus tokens is the target; a source enters at most
    ``max_epochs`` times.
    """

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    share: int = 100
    max_epochs: int = 3
    seed: int = 17


LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def weight_of(level: str, plan: MixPlan) -> Column:
    known = plan.weights.get(level, {})
    out = F.lit(1)
    for name, weight in sorted(known.items()):
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("bigint")


def shared_down(children: DataFrame, parent: Sequence[str], budget: str) -> DataFrame:
    """Share the parent's ``budget`` among its children (weight, capacity): the column ``given``.

    In the order of capacity per weight, a child is full if its capacity is no more than its share of
    what the full ones before it left; the others share the rest.
    """
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.col("capacity") / F.greatest(F.col("weight"), F.lit(1))
    useful = children.withColumn("weight", F.when(F.col("capacity") > 0, F.col("weight")).otherwise(F.lit(0).cast("bigint")))
    order = of.orderBy(ratio, *(F.col(c) for c in LEVELS if c in children.columns))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    takes = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("bigint"))
    step = (
        useful.withColumn("_left", F.col(budget) - F.coalesce(F.sum(takes).over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(of) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_full", F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    )
    rest = (
        step.withColumn("_rest", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), takes)).over(of), F.lit(0)))
        .withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(F.lit(0))).over(of))
    )
    given = F.when(F.col("weight") == 0, F.lit(0)).when(F.col("_full"), F.col("capacity")).otherwise(F.expr("_rest * weight div greatest(_open, 1)"))
    return rest.withColumn("given", given.cast("bigint")).drop("_left", "_weights", "_full", "_rest", "_open")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """(domain, lang, source, tokens, docs, budget) from (domain, lang, source, tokens, docs)."""
    leaf = leaves.withColumn("capacity", F.when(weight_of("source", plan) > 0, F.col("tokens") * plan.max_epochs).otherwise(F.lit(0).cast("bigint")))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    lang = lang.withColumn("capacity", F.when(weight_of("lang", plan) > 0, F.col("capacity")).otherwise(F.lit(0).cast("bigint")))
    domain = lang.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    domain = domain.withColumn("capacity", F.when(weight_of("domain", plan) > 0, F.col("capacity")).otherwise(F.lit(0).cast("bigint")))
    everything = Window.partitionBy(F.lit(0))
    target = F.least(F.expr(f"sum(tokens) over (partition by 0) * {plan.share} div 100"), F.sum("capacity").over(everything))
    top = shared_down(domain.withColumn("weight", weight_of("domain", plan)).withColumn("_target", target), [], "_target")

    def below(children: DataFrame, level: str, keys: list[str], parents: DataFrame) -> DataFrame:
        named = parents.select(*(F.col(k).alias(f"_p_{k}") for k in keys), F.col("given").alias("_parent"))
        match = F.lit(True)
        for k in keys:
            match &= F.col(k).eqNullSafe(F.col(f"_p_{k}"))
        joined = children.join(named, match).drop(*(f"_p_{k}" for k in keys)).withColumn("weight", weight_of(level, plan))
        return shared_down(joined, keys, "_parent")

    langs = below(lang, "lang", ["domain"], top)
    sources = below(leaf, "source", ["domain", "lang"], langs)
    return sources.select("domain", "lang", "source", "tokens", "docs", F.col("given").alias("budget"))


def mix_sources(
    df: DataFrame,
    plan: MixPlan,
    domain: Column,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, with how often the mix takes it.

    Returned as structs, so that no name clashes: ``row`` (the kept columns) and ``mix`` (domain,
    n_tokens, leaf_budget, copies). Nulls in language, source and domain are nodes of their own; a null
    or empty text has no tokens and comes with every whole epoch. Rows with equal ids are ordered by
    length and text, and equal rows are interchangeable. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kept = list(keep if keep is not None else df.columns)
    rows = df.select(
        F.struct(*kept).alias("row"),
        F.monotonically_increasing_id().alias("at"),
        F.col(id).cast("string").alias("id"),
        domain.alias("domain"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        token_count(F.col(text)).alias("n_tokens"),
        F.xxhash64(text).alias("text_hash"),
    )
    rows = freeze(rows, "mix")
    slim = rows.drop("row")
    leaves = freeze(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    budgets = leaf_budgets(leaves, plan)
    budgets = freeze(
        budgets.select(
            *(F.col(c).alias(f"_{c}") for c in LEVELS),
            "budget",
            F.expr("case when tokens = 0 then 0 else budget div tokens end").alias("whole"),
            F.expr("case when tokens = 0 then 0 else budget % tokens end").alias("rest"),
        ),
        "budgets",
    )
    same_leaf = F.lit(True)
    for c in LEVELS:
        same_leaf &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    # Ranges of the seeded order: as many hash digits as leave about RANGE_ROWS rows in one.
    most = leaves.agg(F.max("docs")).first()[0] or 0
    digits = 1
    while 16**digits * RANGE_ROWS < most:
        digits += 1
    partial = slim.join(budgets, same_leaf).where(F.col("rest") > 0)
    leaf_key = F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in LEVELS))
    keyed = partial.select(
        "at",
        "n_tokens",
        "text_hash",
        "rest",
        "id",
        leaf_key.alias("leaf"),
        *LEVELS,
        F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce("id", F.lit(""))).cast("binary")).alias("place"),
    ).withColumn("range", F.substring("place", 1, digits))
    leaf_cols = list(LEVELS)
    inside = Window.partitionBy(*leaf_cols, "range").orderBy("place", "id", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy(*leaf_cols, "range").agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.partitionBy(*leaf_cols).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *(F.col(c).alias(f"_{c}") for c in leaf_cols), F.col("range").alias("_range"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base")
    )
    placed = keyed.withColumn("upto", F.sum("n_tokens").over(inside)).join(bases, same_leaf & (F.col("range") == F.col("_range")))
    chosen = placed.where(F.col("base") + F.col("upto") <= F.col("rest")).select(F.col("at").alias("_at"), F.lit(1).alias("more"))
    out = rows.join(budgets, same_leaf).join(chosen, F.col("at") == F.col("_at"), "left")
    copies = F.col("whole") + F.coalesce(F.col("more"), F.lit(0))
    return out.select("row", F.struct("domain", "n_tokens", F.col("budget").alias("leaf_budget"), copies.cast("bigint").alias("copies")).alias("mix"))
