from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import eventgrove.operators.linkage as linkage
from eventgrove.operators.tree import linkage_to_edges, tree_check


def greedy_ward(points):
    """One-by-one merging with the distance update formula; returns (heights, member sets)."""
    n = len(points)
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    size, members, alive = np.ones(n), [frozenset([i]) for i in range(n)], np.ones(n, dtype=bool)
    heights, sets = [], set()
    for _ in range(n - 1):
        i, j = np.unravel_index(d.argmin(), d.shape)
        h = d[i, j]
        heights.append(np.sqrt(h))
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * h) / (size[i] + size[j] + size)
        new[~alive] = new[i] = new[j] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        alive[j], size[i], members[i] = False, size[i] + size[j], members[i] | members[j]
        sets.add(members[i])
    return np.array(heights), sets


def run(spark, points, **options):
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, features array<double>")
    merges = linkage.ward_linkage(rows, **options).sort("merge").toPandas()
    members = {i: frozenset([i]) for i in range(len(points))}
    for row in merges.itertuples():
        members[row.merge] = members[row.left] | members[row.right]
        assert row.size == len(members[row.merge]) and row.left < row.right < row.merge
    return merges, members


@pytest.mark.parametrize("shape", ["cloud", "clumps"])
def test_tree_equals_greedy_merging(spark, monkeypatch, shape):
    # Small blocks and cells: pruning, splitting and several rounds all take part.
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 16)
    monkeypatch.setattr(linkage, "CELL_ROWS", 12)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(90, 4))
    if shape == "clumps":
        points[:30] *= 0.01  # a third of all points in one spot
        points += 8 * rng.integers(0, 3, size=(90, 1)) * (np.arange(90)[:, None] >= 30)
    merges, members = run(spark, points, tail_rows=20)
    heights, sets = greedy_ward(points)
    assert {members[m] for m in merges["merge"]} == sets
    assert np.allclose(merges["height"], heights, atol=1e-9)
    assert list(merges["merge"]) == list(range(90, 179))


def test_copies_merge_at_height_zero(spark):
    points = np.array([[0.0]] * 11 + [[5.0]] * 3 + [[9.0]])
    merges, members = run(spark, points, tail_rows=2)
    assert (merges["height"] == 0).sum() == 12
    assert frozenset(range(11)) in members.values() and frozenset([11, 12, 13]) in members.values()
    edges = linkage_to_edges(spark.createDataFrame(merges))
    assert tree_check(edges, 15).count() == 0


def test_ids_must_be_dense(spark):
    rows = spark.createDataFrame([(5, [1.0]), (7, [2.0])], "id bigint, features array<double>")
    with pytest.raises(ValueError):
        linkage.ward_linkage(rows)


def test_one_leaf_has_no_merge(spark):
    rows = spark.createDataFrame([(0, [1.0])], "id bigint, features array<double>")
    assert linkage.ward_linkage(rows).count() == 0


def test_one_task_alone_equals_greedy_merging(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 3)) + 6 * rng.integers(0, 4, size=(300, 1))
    merges, members = run(spark, points)
    heights, sets = greedy_ward(points)
    assert {members[m] for m in merges["merge"]} == sets
    assert np.allclose(merges["height"], heights, atol=1e-9)


def test_rounds_in_one_task_equal_greedy_merging(monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 1)
    monkeypatch.setattr(linkage, "CELL_ROWS", 12)
    rng = np.random.default_rng(6)
    points = rng.normal(size=(120, 4)) + 8 * rng.integers(0, 3, size=(120, 1))
    members, made = {i: frozenset([i]) for i in range(120)}, []
    for *_, (merge, left, right, height, size, turn) in linkage._thin(np.arange(120), np.ones(120), np.zeros(120), points, 1):
        for k in range(len(merge)):
            members[merge[k]] = members[left[k]] | members[right[k]]
            assert size[k] == len(members[merge[k]]) and merge[k] // linkage.LEAVES == turn[k] + 1
            made.append((height[k], members[merge[k]]))
    heights, sets = greedy_ward(points)
    assert {m for _, m in made} == sets and np.allclose(sorted(h for h, _ in made), heights, atol=1e-9)


def test_no_round_of_spark_for_what_one_task_holds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "_round", None)
    rng = np.random.default_rng(7)
    points = rng.normal(size=(1300, 3))  # more than are merged one by one
    merges, members = run(spark, points)
    heights, sets = greedy_ward(points)
    assert {members[m] for m in merges["merge"]} == sets and np.allclose(merges["height"], heights, atol=1e-9)


def test_vectors_without_distances_are_an_error(spark):
    points = [[float("nan"), 0.0]] * 4 + [[1.0, float("inf")]] * 4
    rows = spark.createDataFrame([(i, p, i) for i, p in enumerate(points)], "id bigint, features array<double>, k int")
    with pytest.raises(ValueError):
        linkage.ward_linkage(rows.withColumn("features", F.concat("features", F.array(F.col("k").cast("double")))), tail_rows=2)


def test_rounds_share_pivots_and_keep_the_squares(spark, monkeypatch):
    chosen, turns, pivots, round_of = [], [], linkage._pivots, linkage._round
    monkeypatch.setattr(linkage, "_pivots", lambda *args: chosen.append(args[1]) or pivots(*args))
    monkeypatch.setattr(linkage, "_round", lambda *args: turns.append(args[2]) or round_of(*args))
    rng = np.random.default_rng(8)
    points = rng.normal(size=(1500, 3)) + 6 * rng.integers(0, 4, size=(1500, 1))
    merges, members = run(spark, points, tail_rows=1030)
    # A merge at height h adds h * h / 2 to the squares within clusters.
    assert np.isclose((merges["height"] ** 2).sum() / 2, ((points - points.mean(axis=0)) ** 2).sum())
    assert len(merges) == 1499 and len(members[2998]) == 1500
    assert len(turns) > 1 and chosen == [1500]
