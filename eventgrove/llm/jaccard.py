"""Documents with similar word-shingle sets, by a prefix-tree join.

Similar sets share one of the rarest shingles of each (the prefix), so sets meet in groups by the tokens
of their prefixes. Sets that such groups connect form a cluster. A small cluster is settled in one place.
Of a large one, a first round compares sets in blocks, which links most of what is alike; the second
compares every pair that is not connected yet. Within a task all places lie in one trie (see ``trie``).
Only trees of links leave a task, and components are made of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventgrove.llm.components import connected
from eventgrove.llm.shingles import shared_shingles
from eventgrove.llm.trie import forest, linked_pairs
from eventgrove.plans.scratch import freeze

WORDS, PERCENT = 5, 80
#: Sets that meet in one block of a group.
BLOCK = 256
#: A cluster with no more sets and tokens is settled in one place; one with more sets than the last, by token.
CLUSTER_SETS, CLUSTER_TOKENS = 1024, 1 << 22
UNIT_SETS = 1 << 14
#: Tokens in one trie, about.
CHUNK_TOKENS = 1 << 19


def trie_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect what is similar: ``members`` has (place, set_id, component, n_shingles, tokens).

    Sets meet if they have the same place, which holds a bounded number of them.
    """
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            place, ids, component, n, tokens = (list(c) for c in zip(*held))
            place = np.unique(np.array(place), return_inverse=True)[1]
            pairs = linked_pairs(place, np.array(component), np.array(n), tokens, percent)
            tree = forest(len(ids), pairs)
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in tree], type=pa.int64()), pa.array([ids[b] for _, b in tree], type=pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("place", "set_id", "component", "n_shingles", "tokens")]
            lists = columns[4]
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for i, row in enumerate(zip(*(c.to_pylist() for c in columns[:4]))):
                if size > CHUNK_TOKENS and row[0] != held[-1][0]:
                    yield settle()
                    held, size = [], 0
                tokens = values[offsets[i] : offsets[i + 1]].copy()
                held.append((*row, tokens))
                size += len(tokens)
        if held:
            yield settle()

    dealt = members.select("place", "set_id", "component", "n_shingles", "tokens").repartition(parts, "place").sortWithinPartitions("place")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def prefix_length(percent: int) -> Column:
    """Tokens of the prefix: all but what similarity needs, plus one, without those that nobody shares."""
    needed = F.expr(f"({percent} * n_shingles + 99) div 100")
    return F.size("tokens") - needed + 1


def hash_block(name: str, blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.col(name), F.lit(salt)), blocks)


def similar_components(sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, root) of the sets that are linked, but for the smallest of each component.

    ``sets`` has (set_id, n_shingles, tokens), each set once.
    """
    prefix = sets.select("set_id", F.explode(F.slice("tokens", F.lit(1), prefix_length(percent))).alias("token"))
    prefix = freeze(prefix, "prefix")
    mixed_id = F.xxhash64("set_id")
    # Tokens with the same sets make the same group; one of them is enough.
    lists = prefix.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(mixed_id).alias("x"), F.sum(F.shiftright(mixed_id, 24)).alias("s"), F.min("set_id").alias("least")
    )
    groups = lists.where("members > 1").groupBy("members", "x", "s", "least").agg(F.min("token").alias("token")).select("token", "members")
    member = freeze(prefix.join(groups, "token"), "groups")

    # Clusters: what groups connect. Most are small, and all their pairs are settled in one place.
    star = member.groupBy("token").agg(F.min("set_id").alias("b"))
    ends = connected(member.join(star, "token").select(F.col("set_id").alias("a"), "b"))
    clustered = member.select("set_id").distinct().join(ends.toDF("set_id", "root"), "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("cluster"))
    clustered = freeze(clustered.join(sets.select("set_id", F.size("tokens").alias("n_tokens")), "set_id"), "clusters")
    sizes = freeze(clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("held"), F.sum("n_tokens").alias("tokens")), "sizes")
    is_small = (F.col("held") <= CLUSTER_SETS) & (F.col("tokens") <= CLUSTER_TOKENS)
    whole = clustered.join(sizes.where(is_small), "cluster").select(F.xxhash64("cluster").alias("place"), "set_id", F.col("set_id").alias("component"))
    settled = freeze(trie_links(whole.join(sets, "set_id"), percent), "links")
    large = sizes.where(~is_small & (F.col("held") > 1))
    if not large.limit(1).count():
        return connected(settled).toDF("set_id", "root")
    rest = clustered.join(large, "cluster")
    # A large cluster is one unit; in a very large one each group of a token is.
    by_cluster = rest.where(F.col("held") <= UNIT_SETS).select(F.xxhash64("cluster", F.lit("c")).alias("unit"), "set_id")
    by_token = rest.where(F.col("held") > UNIT_SETS).join(member, "set_id").select(F.xxhash64("token", F.lit("t")).alias("unit"), "set_id")
    units = freeze(by_cluster.unionByName(by_token), "units")

    # Round 1: each set in one unit, in blocks.
    counted = units.groupBy("unit").agg(F.count(F.lit(1)).alias("members"))
    chosen = units.groupBy("set_id").agg(F.min(F.struct(F.xxhash64("unit").alias("h"), "unit")).alias("u")).select("set_id", "u.unit").join(counted, "unit")
    place = F.xxhash64("unit", hash_block("set_id", F.ceil(F.col("members") / BLOCK), 5))
    first = chosen.select(place.alias("place"), "set_id", F.col("set_id").alias("component")).join(sets, "set_id")
    roots = connected(freeze(trie_links(first, percent), "links"))

    # Round 2: pairs that share a unit and are not connected, whatever the unit's size.
    labelled = units.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").select("unit", "set_id", F.coalesce("root", "set_id").alias("component"))
    shares = freeze(labelled.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("held")), "shares")
    split = shares.groupBy("unit").agg(F.count(F.lit(1)).alias("parts"), F.sum("held").alias("members"), F.max(F.struct("held", "component")).alias("most")).where("parts > 1")
    # The largest component of a unit is not compared with itself; blocks of it meet the blocks of the rest.
    split = split.select(
        "unit",
        F.col("most.component").alias("largest"),
        F.when(F.col("members") > BLOCK, F.ceil(F.col("most.held") / BLOCK)).otherwise(F.lit(0)).alias("large_blocks"),
        F.when(F.col("members") > BLOCK, F.ceil((F.col("members") - F.col("most.held")) / BLOCK)).otherwise(F.lit(1)).alias("small_blocks"),
    )
    open_ = labelled.join(split, "unit")
    is_large = (F.col("component") == F.col("largest")) & (F.col("large_blocks") > 0)
    mine = F.when(is_large, hash_block("set_id", F.greatest("large_blocks", F.lit(1)), 6)).otherwise(F.col("large_blocks") + hash_block("set_id", F.col("small_blocks"), 7))
    small = F.sequence(F.col("large_blocks"), F.col("large_blocks") + F.col("small_blocks") - 1)
    every = F.sequence(F.lit(0).cast("bigint"), F.col("large_blocks") + F.col("small_blocks") - 1)
    meets = F.when(is_large, small).otherwise(every)
    placed = open_.withColumn("mine", mine).select("unit", "set_id", "component", "mine", F.explode(meets).alias("other"))
    place = F.xxhash64("unit", F.least("mine", "other"), F.greatest("mine", "other"))
    second = placed.select(place.alias("place"), "set_id", "component").join(sets, "set_id")
    more = freeze(trie_links(second, percent), "links")
    tree = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected(settled.unionByName(tree).unionByName(more)).select(F.col("node").alias("set_id"), "root")


def similar_documents(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``df``.

    * A document's set has its distinct shingles of ``words`` words (A-Z in lower case), or its whole word
      sequence if that is shorter. Two rows link when 100 * intersection >= percent * union; the
      component's id is the smallest id among its rows. Ids are integers.
    * Null and empty texts have an empty set and are linked with nothing: their component is their own id,
      null for a null id. A linked row with a null id takes the smallest id that is not null, if there is one.
    * Equal sets are one set in the join, so copies and repeated rows need no pairs. An empty table gives
      an empty result. Sets are compared by 43 to 56 bits of each shingle's hash.
    """
    rows = shared_shingles(df, words, percent, id, text)
    rows = freeze(rows.select(F.monotonically_increasing_id().alias("at"), F.col("id").alias("doc_id"), "n_shingles", "tokens"), "shingles")
    held = rows.where(F.col("tokens").isNotNull())
    # A set with a shingle of its own equals no other; the others are told apart by two hashes.
    alone = F.when(F.size("tokens") < F.col("n_shingles"), F.col("at"))
    keys = held.select("at", "doc_id", F.xxhash64("tokens").alias("h1"), F.hash("tokens", F.lit(1)).alias("h2"), "n_shingles", F.coalesce(alone, F.lit(-1)).alias("alone"))
    names = ["h1", "h2", "n_shingles", "alone"]
    keys = freeze(keys, "keys")
    folded = freeze(keys.groupBy(*names).agg(F.min("at").alias("set_id"), F.min("doc_id").alias("least")), "sets")
    # A set with a shingle of its own stands for itself; only the others are looked up among the smallest of each kind.
    shared = held.where(alone.isNull()).join(folded.where("alone = -1").select(F.col("set_id").alias("at")), "at", "left_semi")
    sets = held.where(alone.isNotNull()).unionByName(shared).select(F.col("at").alias("set_id"), "n_shingles", "tokens")
    sets = freeze(sets, "tokens")
    roots = freeze(similar_components(sets, percent), "components")
    rooted = folded.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names_of = freeze(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    labelled = rooted.join(names_of, "root").select(*names, "component_id")
    by_row = keys.join(labelled, names).select("at", "component_id")
    return rows.join(by_row, "at", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
