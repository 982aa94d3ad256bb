"""Tree operators on deep, wide and uneven trees, against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventgrove.operators.naming import path_names
from eventgrove.operators.tree import node_depth, node_height, path_fold, rollup_distribution, rollup_son, root_path, tree_intervals

SCHEMA = "child bigint, parent bigint, label int"


def random_tree(seed, n, reach):
    """Each node hangs below one of the ``reach`` nodes before it: deep for a small reach, wide for a large one."""
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(ids[i], None if i == 0 else ids[rng.randrange(max(0, i - reach), i)], None) for i in range(n)]


class Plain:
    """The tree in memory; its nodes in an order in which parents come first."""

    def __init__(self, edges):
        self.parent = {c: p for c, p, _ in edges}
        self.children = defaultdict(list)
        for child, parent in sorted(self.parent.items()):
            if parent is not None:
                self.children[parent].append(child)
        root = next(c for c, p in self.parent.items() if p is None)
        self.order, todo = [], [root]
        while todo:
            node = todo.pop()
            self.order.append(node)
            todo += reversed(self.children[node])
        self.leaves = [n for n in self.order if not self.children[n]]
        self.depth, self.size, self.height = {}, {}, {}
        for n in self.order:
            self.depth[n] = 0 if self.parent[n] is None else self.depth[self.parent[n]] + 1
        for n in reversed(self.order):
            self.size[n] = 1 + sum(self.size[c] for c in self.children[n])
            self.height[n] = max((self.height[c] + 1 for c in self.children[n]), default=0)


TREES = {"deep": random_tree(1, 90, 2), "wide": random_tree(2, 300, 300), "star": random_tree(3, 100, 10**6)[:1] + [(c, random_tree(3, 100, 10**6)[0][0], None) for c, _, _ in random_tree(3, 100, 10**6)[1:]], "one": [(7, None, 0)]}


@pytest.fixture(params=list(TREES))
def case(request, spark):
    rows = TREES[request.param]
    return Plain(rows), spark.createDataFrame(rows, SCHEMA).repartition(3)


def shares(tree, seed=4):
    rng = random.Random(seed)
    return [(leaf, token, rng.random()) for leaf in tree.leaves for token in rng.sample("abcde", rng.randrange(4))]


def test_places(case):
    tree, edges = case
    got = {r["node"]: (r["depth"], r["first"], r["last"]) for r in tree_intervals(edges).collect()}
    assert got == {n: (tree.depth[n], i, i + tree.size[n]) for i, n in enumerate(tree.order)}
    assert {r["node"]: r["depth"] for r in node_depth(edges).collect()} == tree.depth
    assert {r["node"]: r["height"] for r in node_height(edges).collect()} == tree.height


def test_paths_and_names(spark, case):
    tree, edges = case
    want = {}
    for n in tree.order:
        want[n] = [*want.get(tree.parent[n], []), n]
    assert {r["node"]: r["path"] for r in root_path(edges).collect()} == want
    names = {n: f"n{n % 5}" for n in tree.order if n % 7}
    got = path_names(edges, spark.createDataFrame(list(names.items()), "node bigint, name string")).collect()
    between = {leaf: [names[n] for n in want[leaf][1:-1] if n in names] for leaf in tree.leaves}
    assert {r["node"]: r["names"] for r in got} == {leaf: list(dict.fromkeys(x)) for leaf, x in between.items()}


def test_rollup(spark, case):
    tree, edges = case
    rows = shares(tree)
    sums, leaves = defaultdict(float), defaultdict(int)
    for leaf in tree.leaves:
        node = leaf
        while node is not None:
            leaves[node] += 1
            for _, token, prob in (r for r in rows if r[0] == leaf):
                sums[node, token] += prob
            node = tree.parent[node]
    dist = spark.createDataFrame(rows, "node bigint, token string, prob double")
    got = {(r["node"], r["token"]): r["prob"] for r in rollup_distribution(dist, edges).collect()}
    assert got == pytest.approx({k: v / leaves[k[0]] for k, v in sums.items()})


def dense_son(tree, rows, tokens, vocabulary):
    """(node -> token -> value, None for all other tokens) from the leaves up."""
    out = {leaf: dict.fromkeys([*tokens, None], 0.0) for leaf in tree.leaves}
    for leaf, token, prob in rows:
        out[leaf][token] = prob
    for n in reversed(tree.order):
        if tree.children[n]:
            e = {t: math.exp(sum(out[c][t] for c in tree.children[n]) / len(tree.children[n])) for t in (*tokens, None)}
            whole = sum(v for t, v in e.items() if t is not None) + (vocabulary - len(tokens)) * e[None]
            out[n] = {t: v / whole for t, v in e.items()}
    return out


@pytest.mark.parametrize("cells", [10**6, 100])
def test_rollup_son_in_parts(spark, case, cells):
    tree, edges = case
    rows = shares(tree)
    want = dense_son(tree, rows, "abcde", 9)
    dist = spark.createDataFrame(rows, "node bigint, token string, prob double")
    values, absent = rollup_son(dist, edges, 9, part_cells=cells)
    rest = {r["node"]: r["absent"] for r in absent.collect()}
    assert rest == pytest.approx({n: v[None] for n, v in want.items()})
    explicit = {(r["node"], r["token"]): r["prob"] for r in values.collect()}
    assert {(n, t): explicit.get((n, t), rest[n]) for n in tree.order for t in "abcde"} == pytest.approx({(n, t): want[n][t] for n in tree.order for t in "abcde"})
    assert len(explicit) == len(values.collect())


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("parent"), F.lit(0).alias("label"))


def test_deep_chain(spark):
    """100,000 nodes in a row: the closure would have 5e9 rows."""
    n = 100_000
    edges = chain(spark, n)
    found = tree_intervals(edges)
    off = found.where((F.col("depth") != n - 1 - F.col("node")) | (F.col("first") != F.col("depth")) | (F.col("last") != n))
    assert found.count() == n and off.count() == 0


def test_rollups_of_a_chain(spark):
    n = 2_000
    edges = chain(spark, n)
    names = edges.select(F.col("child").alias("node"), (F.col("child") % 3).cast("string").alias("name"))
    assert path_names(edges, names).first()["names"] == [str((n - 2 - i) % 3) for i in range(3)]
    dist = spark.createDataFrame([(0, "a", 0.25), (0, "b", 0.75)], "node bigint, token string, prob double")
    rolled = rollup_distribution(dist, edges)
    assert rolled.count() == 2 * n and rolled.where("abs(prob - if(token = 'a', 0.25, 0.75)) > 1e-12").count() == 0
    values, absent = rollup_son(dist, edges, 4)
    a, b, rest = 0.25, 0.75, 0.0
    for _ in range(n - 1):
        e = [math.exp(x) for x in (a, b, rest)]
        a, b, rest = (x / (e[0] + e[1] + 2 * e[2]) for x in e)
    top = {r["token"]: r["prob"] for r in values.where(f"node = {n - 1}").collect()}
    assert top == pytest.approx({"a": a, "b": b}) and absent.where(f"node = {n - 1}").first()["absent"] == pytest.approx(rest)
    assert values.count() == 2 * n and absent.count() == n


def test_a_cycle_is_refused(spark):
    ring = spark.createDataFrame([(1, 2), (2, 1)], "node bigint, jump bigint").withColumn("v", F.lit(1))
    with pytest.raises(ValueError, match="tree"):
        path_fold(ring, {"v": lambda own, above: own})
