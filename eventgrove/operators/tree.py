"""Operators on a rooted tree given as edges (child, parent, label); the root's parent is null.

What a node's path or subtree adds up to comes from pointers that reach twice as far in each round, so a
tree of depth d takes about log2(d) rounds, and a round holds one row per node (``path_fold``) or per row
of the result so far (``subtree_fold``). Only ``tree_closure`` makes a row per node and ancestor, because
those rows are its result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgrove.plans.ordering import dense_index, group_rank, group_running_sum
from eventgrove.plans.scratch import freeze, scratch_path

#: Heights that one round of ``rollup_son`` may settle, and the numbers that one part of the tree may hold.
BAND_HEIGHTS = (4096, 512, 64, 8, 1)
PART_CELLS = 2_000_000


def linkage_to_edges(merges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Two edges per merge and one root row; ``labels`` (child, label) names the leaves, 0 by default."""
    pairs = merges.select(F.col("merge").alias("parent"), F.explode(F.array("left", "right")).alias("child"))
    internal = merges.select(F.col("merge").alias("child"), F.lit(True).alias("_internal"))
    roots = internal.join(pairs.select("child"), "child", "left_anti").select(
        "child", F.lit(None).cast("bigint").alias("parent")
    )
    edges = pairs.select("child", "parent").unionByName(roots).join(internal, "child", "left")
    if labels is not None:
        edges = edges.join(labels.select("child", "label"), "child", "left")
    else:
        edges = edges.withColumn("label", F.lit(0))
    return edges.select(
        "child", "parent", F.when(F.col("_internal").isNull(), F.col("label").cast("int")).alias("label")
    )


def leaves_of(edges: DataFrame) -> DataFrame:
    parents = edges.select(F.col("parent").alias("node")).where("node is not null")
    return edges.select(F.col("child").alias("node")).join(parents, "node", "left_anti")


def renumber_tree(edges: DataFrame) -> DataFrame:
    """Leaves keep their id; with n leaves the internal nodes become n.. by old id, the root last."""
    n = leaves_of(edges).count()
    parents = edges.select(F.col("parent").alias("node")).where("node is not null").distinct()
    internal = edges.join(parents, F.col("child") == F.col("node")).select(
        "node", F.col("parent").isNull().alias("is_root")
    )
    ids = freeze(dense_index(internal, [F.col("is_root"), F.col("node")], "_rank"), "renumbered")
    new = lambda side: ids.select(F.col("node").alias(side), (F.col("_rank") + n).alias(f"new_{side}"))
    return edges.join(new("child"), "child", "left").join(new("parent"), "parent", "left").select(
        F.coalesce("new_child", "child").alias("child"), F.col("new_parent").alias("parent"), "label"
    )


def tree_check(edges: DataFrame, n: int) -> DataFrame:
    """Violations (check, node): leaves other than 0..n-1, and roots beyond the first."""
    leaves = leaves_of(edges)
    wanted = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    roots = edges.where("parent is null").agg(F.count(F.lit(1)).alias("n"), F.max("child").alias("node")).where("n != 1")
    tagged = lambda df, check: df.select(F.lit(check).alias("check"), "node")
    return (
        tagged(leaves.join(wanted, "node", "left_anti"), "leaf outside 0..n-1")
        .unionByName(tagged(wanted.join(leaves, "node", "left_anti"), "leaf missing"))
        .unionByName(tagged(roots, "not exactly one root"))
    )


def tree_closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance), each node its own ancestor at distance 0.

    Pointer doubling: with all pairs up to distance r known, a pair at exactly r followed by any
    known pair gives the distances r+1..2r, so a tree of depth d takes log2(d) rounds.
    """
    closure = freeze(
        edges.where("parent is not null").select(
            F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")
        ),
        "closure",
    )
    reach = 1
    while True:
        ends = closure.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"))
        beyond = closure.select(F.col("node").alias("via"), "ancestor", (F.col("distance") + reach).alias("distance"))
        step = freeze(ends.join(beyond, "via").select("node", "ancestor", "distance"), "closure")
        if step.isEmpty():
            break
        closure = closure.unionByName(step)
        reach *= 2
    itself = edges.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("distance"))
    return itself.unionByName(closure)


def path_fold(nodes: DataFrame, folds: Mapping[str, Callable[[Column, Column], Column]], label: str = "path") -> DataFrame:
    """For each node, its values folded over the path to the root: (node, values).

    ``nodes``: node, jump (the parent; null where the path ends) and a column per fold. A fold takes a
    node's value so far and that of the node its pointer has reached, which lies above. Each round joins the
    nodes that are still under way to all nodes and takes over the other's pointer.
    """
    spark, path = nodes.sparkSession, scratch_path(nodes.sparkSession, label)
    layout = nodes.select("node", "jump", *folds).withColumn("round", F.lit(0)).withColumn("open", F.lit(True)).schema

    def write(df: DataFrame, number: int) -> None:
        marked = df.withColumn("round", F.lit(number)).withColumn("open", F.col("jump").isNotNull())
        marked.write.partitionBy("round", "open").mode("append").parquet(path)

    write(nodes.select("node", "jump", *folds), 0)
    for number in range(nodes.count().bit_length() + 2):
        written = spark.read.schema(layout).parquet(path)
        todo, done = (F.col("round") == number) & F.col("open"), ~F.col("open")
        if written.where(todo).isEmpty():
            return written.where(done).select("node", *folds)
        above = written.where(todo | done).select(F.col("node").alias("jump"), F.col("jump").alias("_next"), *(F.col(c).alias(f"_{c}") for c in folds))
        merged = [fold(F.col(c), F.col(f"_{c}")).alias(c) for c, fold in folds.items()]
        write(written.where(todo).join(above, "jump").select("node", F.col("_next").alias("jump"), *merged), number + 1)
    raise ValueError("the edges do not form a tree")


def subtree_fold(values: DataFrame, edges: DataFrame, keys: Sequence[str], amount: str, fold: Callable[[str], Column] = F.sum) -> DataFrame:
    """(node, keys, amount): ``fold`` (sum, max or min) of the amounts in each node's subtree, key by key.

    After a round that knows all nodes less than r below, what the nodes exactly r below know is added, so
    2 r is reached. No round holds more rows than the result; equal keys combine map-side, so neither the
    root nor a hot node gathers rows.
    """
    own = lambda df: df.groupBy("node", *keys).agg(fold(amount).alias(amount))
    known = freeze(own(values.select("node", *keys, amount)), "subtree")
    jumps = edges.where("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("jump"))
    jumps = freeze(jumps, "jumps")
    left = jumps.count()
    for _ in range(left.bit_length() + 2):
        if not left:
            return known
        lifted = known.join(jumps, "node").select(F.col("jump").alias("node"), *keys, amount)
        known = freeze(own(known.unionByName(lifted)), "subtree")
        jumps = freeze(jumps.join(jumps.select(F.col("node").alias("jump"), F.col("jump").alias("_next")), "jump").select("node", F.col("_next").alias("jump")), "jumps")
        left = jumps.count()
    raise ValueError("the edges do not form a tree")


def _upward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("jump"))


def node_depth(edges: DataFrame) -> DataFrame:
    """(node, depth): steps to the root."""
    start = _upward(edges).withColumn("depth", F.col("jump").isNotNull().cast("int"))
    return path_fold(start, {"depth": lambda own, above: own + above}, "depth")


def root_path(edges: DataFrame) -> DataFrame:
    """(node, path): nodes from the root down to each node; stretches of the path are put together, twice as long each round."""
    start = _upward(edges).withColumn("path", F.array("node"))
    return path_fold(start, {"path": lambda own, above: F.concat(above, own)}, "path")


def tree_intervals(edges: DataFrame) -> DataFrame:
    """(node, depth, first, last): place in pre-order (children by id) and the end of the subtree's places.

    ``a`` is an ancestor of ``b``, or ``b`` itself, exactly if ``a.first <= b.first < a.last``; the subtree
    of a node has ``last - first`` nodes. Ancestry of any pair is thus known from n rows, for trees whose
    closure would not fit. A node lies behind its parent, plus the subtrees of its smaller siblings.
    """
    sizes = subtree_fold(edges.select(F.col("child").alias("node"), F.lit(1).cast("bigint").alias("size")), edges, [], "size")
    below = edges.where("parent is not null").select(F.col("child").alias("node"), "parent").join(sizes, "node")
    ranked = freeze(group_rank(below, ["parent"], [F.col("node")], "_rank", "_siblings").drop("_siblings"), "siblings")
    placed = group_running_sum(ranked, ["parent"], "_rank", F.col("size"), "_before")
    roots = edges.where("parent is null").select(F.col("child").alias("node"), F.lit(None).cast("bigint").alias("jump"), F.lit(0).cast("bigint").alias("first"), F.lit(0).alias("depth"))
    start = placed.select("node", F.col("parent").alias("jump"), (F.col("_before") + 1).cast("bigint").alias("first"), F.lit(1).alias("depth")).unionByName(roots)
    add = lambda own, above: own + above
    return path_fold(start, {"first": add, "depth": add}, "places").join(sizes, "node").select("node", "depth", "first", (F.col("first") + F.col("size")).alias("last"))


def rollup_distribution(dist: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, token, prob): the mean over a node's leaves, an absent token counting as 0.

    ``dist`` holds the leaves. Tokens and leaves are summed up the tree together.
    """
    leaves = leaves_of(edges)
    tokens = dist.join(leaves, "node", "left_semi").select("node", "token", F.lit(False).alias("_leaf"), F.col("prob").cast("double").alias("prob"))
    counted = leaves.select("node", F.lit(None).cast("string").alias("token"), F.lit(True).alias("_leaf"), F.lit(1.0).alias("prob"))
    summed = subtree_fold(tokens.unionByName(counted), edges, ["token", "_leaf"], "prob")
    n_leaves = summed.where("_leaf").select("node", F.col("prob").alias("n_leaves"))
    return summed.where("not _leaf").join(n_leaves, "node").select("node", "token", (F.col("prob") / F.col("n_leaves")).alias("prob"))


def node_height(edges: DataFrame) -> DataFrame:
    """(node, height): steps to the lowest leaf below."""
    depth = freeze(node_depth(edges), "depth")
    lowest = subtree_fold(depth, edges, [], "depth", F.max)
    return lowest.withColumnRenamed("depth", "_lowest").join(depth, "node").select("node", (F.col("_lowest") - F.col("depth")).alias("height"))


def _parts(inner: DataFrame, heights: int) -> DataFrame:
    """``inner`` (node, parent, height, rows) with its band and part: connected nodes whose heights lie in one band."""
    banded = inner.withColumn("band", F.floor((F.col("height") - 1) / heights).cast("int"))
    above = banded.select(F.col("node").alias("parent"), F.col("band").alias("_band"))
    start = banded.join(above, "parent", "left").select(
        "node", F.when(F.col("band") == F.col("_band"), F.col("parent")).alias("jump"), F.col("node").alias("part")
    )
    tops = path_fold(start, {"part": lambda own, above: above}, "parts")
    return freeze(banded.join(tops, "node"), "parts")


def _settle_part(vocabulary_size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Bottom-up softmax of one part, on numbers per node and token of the part.

    Rows with a token are sums of children outside the part; rows without one describe a node: parent,
    height, children outside and the sum of their absent values.
    """

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows.is_node].sort_values("height", kind="stable")
        at = {node: i for i, node in enumerate(nodes.node)}
        sums = rows[~rows.is_node]
        codes, tokens = pd.factorize(sums.token)
        extra = np.zeros((len(nodes), len(tokens)))
        held = np.zeros((len(nodes), len(tokens)), dtype=bool)
        row = sums.node.map(at).to_numpy(dtype=np.int64)
        extra[row, codes] = sums.value.to_numpy()
        held[row, codes] = True
        children, absent = nodes.children.to_numpy(dtype=float).copy(), nodes.value.to_numpy(dtype=float).copy()
        out = []
        for i, (node, parent) in enumerate(zip(nodes.node, nodes.parent)):
            rest = np.exp(absent[i] / children[i])
            weight = np.exp((absent[i] + extra[i]) / children[i])
            whole = weight.sum() + (vocabulary_size - len(tokens)) * rest
            prob, low = weight / whole, rest / whole
            known = held[i]
            out.append(pd.DataFrame({"node": node, "token": [*tokens[known], None], "prob": [*prob[known], low], "is_absent": [False] * int(known.sum()) + [True]}))
            above = at.get(parent)
            if above is not None:
                children[above] += 1
                absent[above] += low
                extra[above] += prob - low
                held[above] |= known
        return pd.concat(out, ignore_index=True)

    return settle


def rollup_son(dist: DataFrame, edges: DataFrame, vocabulary_size: int, part_cells: int = PART_CELLS) -> tuple[DataFrame, DataFrame]:
    """Alternative roll-up: a node is the softmax of the plain mean of its children.

    Softmax gives every absent token the same non-zero value, so the result is two tables: the
    explicit (node, token, prob) and the (node, absent) value of all other tokens of the vocabulary.

    Softmax cannot be summed up the tree, so nodes wait for their children. The tree is cut into parts:
    connected nodes whose heights lie in one band. A part of at most ``part_cells`` numbers is settled in
    one step, and a round settles all parts of a band, so rounds are height / band, not height. The highest
    band is taken at which every part is that small; single nodes always are if the vocabulary is. What
    enters a part from below is summed map-side before, so many children are no large part. Values are
    appended to one table, laid out by the band that waits for them, so a round reads what it needs.
    """
    spark = edges.sparkSession
    leaves = freeze(leaves_of(edges), "leaves")
    given = dist.join(leaves, "node", "left_semi").select("node", "token", F.col("prob").cast("double").alias("prob"))
    below = subtree_fold(given.groupBy("node").agg(F.count(F.lit(1)).alias("rows")), edges, [], "rows")
    inner = freeze(
        edges.select(F.col("child").alias("node"), "parent").join(node_height(edges).where("height > 0"), "node").join(below, "node", "left").fillna(0, ["rows"]),
        "inner",
    )
    highest = inner.agg(F.max("height")).first()[0] or 0
    fits = F.max(F.col("n") * F.least(F.greatest("rows", F.lit(1)), F.lit(vocabulary_size))) <= part_cells
    for heights in [h for h in BAND_HEIGHTS if h == 1 or 2 * h <= max(highest, 2) * 32]:
        parts = _parts(inner, heights)
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows"))
        if heights == 1 or sizes.agg(fits).first()[0] in (None, True):
            break
    # Where each node's value goes: its parent and the parent's band; what stays inside a part does not travel.
    homes = parts.select(F.col("node").alias("parent"), F.col("band").alias("to_band"), F.col("part").alias("to_part"))
    route = edges.select(F.col("child").alias("node"), "parent").join(homes, "parent", "left").join(parts.select("node", "part"), "node", "left")
    home = F.when(~F.col("part").eqNullSafe(F.col("to_part")), F.col("to_band")).alias("to_band")
    route = freeze(route.select("node", "parent", home), "route")
    path = scratch_path(spark, "rolled")
    kinds = "node bigint, token string, prob double, is_absent boolean"
    rolled = lambda: spark.read.schema(f"{kinds}, parent bigint, to_band int").parquet(path)
    add = lambda df: df.join(route, "node").select("node", "token", "prob", "is_absent", "parent", "to_band").write.partitionBy("to_band").mode("append").parquet(path)
    none = F.lit(None).cast("string").alias("token")
    add(given.withColumn("is_absent", F.lit(False)).unionByName(leaves.select("node", none, F.lit(0.0).alias("prob"), F.lit(True).alias("is_absent"))))
    for band in range(-(-highest // heights)):
        arrived = rolled().where(F.col("to_band") == band)
        low = arrived.where("is_absent")
        base = low.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("prob").alias("value"))
        shape = parts.where(F.col("band") == band).join(base, "node", "left").select(
            "part", "node", F.lit(True).alias("is_node"), "parent", "height", F.coalesce("children", F.lit(0)).alias("children"), none, F.coalesce("value", F.lit(0.0)).alias("value")
        )
        high = arrived.where("not is_absent").join(low.select("node", F.col("prob").alias("low")), "node")
        lifted = high.groupBy(F.col("parent").alias("node"), "token").agg(F.sum(F.col("prob") - F.col("low")).alias("value"))
        tokens = lifted.join(parts.where(F.col("band") == band).select("node", "part"), "node").select(
            "part", "node", F.lit(False).alias("is_node"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("height"), F.lit(0).cast("bigint").alias("children"), "token", "value"
        )
        add(shape.unionByName(tokens).groupBy("part").applyInPandas(_settle_part(vocabulary_size), kinds))
    whole = rolled()
    return whole.where("not is_absent").select("node", "token", "prob"), whole.where("is_absent").select("node", F.col("prob").alias("absent"))
