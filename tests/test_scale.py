"""What must not grow faster than the rows: copies, tasks, moved columns and memory."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventgrove.functions import tags as tg
from eventgrove.functions import tokens as tk
from eventgrove.operators import evaluate, linkage
from eventgrove.operators.mentions import annotate
from eventgrove.operators.prompts import locate_triggers, sample_demonstrations
from eventgrove.plans import salient
from eventgrove.plans.scratch import TASKS_PER_CORE, use_all_cores
from eventgrove.sources import blocks


@pytest.mark.parametrize("n", [0, 1, tk.SUM_PIECE, tk.SUM_PIECE + 1, 5 * tk.SUM_PIECE, 777])
def test_running_sum_of_long_arrays(one, n):
    counts = [(7 * i) % 5 for i in range(n)]
    out = one("c array<int>", [counts], tk.running_sum(F.col("c")))
    assert out == [sum(counts[:i]) for i in range(n)]


def test_running_sum_keeps_nulls(one):
    counts = [1] * 30 + [None] + [1] * 30
    out = one("c array<int>", [counts], tk.running_sum(F.col("c")))
    assert out == list(range(31)) + [None] * 30
    assert one("c array<int>", [None], tk.running_sum(F.col("c"))) is None


def test_rule_description_equals_the_text_of_all_tags(spark):
    rows = [("a", "walked"), ("b", "we walked"), ("c", "x walked y talked z w"), ("d", "a b c d e walked f g h i talking"), ("e", "none")]
    corpus = spark.createDataFrame(rows, "sent_id string, t string").select("sent_id", F.split("t", " ").alias("tokens"))
    frames = annotate(corpus).select("words", F.explode("frames").alias("f"))
    wrong = frames.where(F.col("f.description") != tg.frame_text(F.col("words"), F.col("f.tags")))
    assert frames.count() == 6 and wrong.count() == 0


def test_short_splits_share_tasks(tmp_path):
    text = "".join(f"line {i}\n\n" for i in range(40_000))
    (tmp_path / "a.txt").write_text(text)
    reader = blocks.BlockReader({"path": str(tmp_path), "suffix": ".txt", "splitbytes": "100"})
    tasks = reader.partitions()
    assert len(tasks) <= 2 * blocks.MOST_TASKS
    assert sum(len(t.splits) for t in tasks) == -(-len(text) // 100)
    found = [v for t in tasks for batch in reader.read(t) for v in batch.column("value").to_pylist()]
    assert found == [f"line {i}" for i in range(40_000)]


def test_words_move_once_per_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bounds = spark.createDataFrame([("d", 0, 3, ["a", "b", "c"]), ("d", 3, 5, ["e", "f"])], "key string, start int, end int, payload array<string>")
        triggers = spark.createDataFrame([("d", 1, "x"), ("d", 4, "y"), ("d", 4, "z"), ("d", 9, "w")], "key string, trigger_start int, kind string")
        found = locate_triggers(triggers, bounds, "key")
        plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        exchanges = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip())]
        assert sum("payload" in part for part in exchanges) == 1
        assert sorted(map(tuple, found.select("kind", "start", "local_index").collect())) == [("x", 0, 1), ("y", 3, 1), ("z", 3, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_are_decoded_in_slices(monkeypatch):
    monkeypatch.setattr(evaluate, "SLICE_NUMBERS", 20)
    rows = [[[0.1, 0.9]] * n for n in (3, 0, 50, 1, 1, 4)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=["probs"])
    parts = list(evaluate._slices(batch, "probs", 2))
    assert [row for part in parts for row in part.column("probs").to_pylist()] == rows
    assert len(parts) > 1 and max(sum(len(r or []) for r in p.column("probs").to_pylist()) for p in parts[1:]) <= 10


def test_a_small_table_has_several_tasks_per_core(spark):
    assert use_all_cores(spark.range(10).coalesce(1), TASKS_PER_CORE).rdd.getNumPartitions() == TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def test_a_search_of_regions_yields_bounded_frames():
    rng = np.random.default_rng(1)
    points, counts = rng.normal(size=(64, 3)), rng.integers(0, 40, size=64)
    regions = linkage._regions(points, counts, 200)
    assert sorted(np.concatenate(regions)) == list(range(64))
    assert all(len(r) == 1 or counts[r].sum() <= 200 for r in regions)


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_closest_equals_plain_differences(monkeypatch, far):
    monkeypatch.setattr(linkage, "MATRIX_NUMBERS", 300)
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(70, 5)), 1) + far  # rounded, so that there are ties
    sizes, ids = rng.integers(1, 5, size=70).astype(float), np.arange(70) * 3
    plain = linkage._ward(sizes[:, None], sizes[None, :], linkage._squared_gaps(points, points))
    np.fill_diagonal(plain, np.inf)
    distance, place = linkage._closest(points, points, sizes, sizes, ids, ids)
    assert (place == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_draws_meet_texts_by_number(spark):
    demos = spark.createDataFrame([("t", "o", "p"), ("t", "o", "p"), (None, "n", "q"), ("s", None, "r")], "input string, output string, predicate string")
    targets = spark.createDataFrame([(f"x{i}",) for i in range(60)], "target_id string")
    drawn = sample_demonstrations(targets, demos, k=3, seed=7)
    assert drawn.columns == ["target_id", "draw", "input", "output", "predicate"]
    assert "_text_id" in drawn._jdf.queryExecution().toString()  # not the texts themselves
    rows = drawn.collect()
    assert len(rows) == 180 and {(r["input"], r["output"], r["predicate"]) for r in rows} == {tuple(r) for r in demos.collect()}


def test_indices_do_not_travel_with_rule_mentions(spark, monkeypatch):
    corpus = spark.createDataFrame([("1", "1-0", 0, ["we", "walked"])], "doc_id string, sent_id string, sent_num int, tokens array<string>")
    seen = []
    monkeypatch.setattr(salient, "rank_in_document", lambda scored, plain=salient.rank_in_document: seen.extend(scored.columns) or plain(scored))
    rows = salient.salient_mentions(corpus, None).collect()
    assert "indices" not in seen and [(r["token"], r["indices"], r["token_index"]) for r in rows] == [("walked", [1], 1)]


def test_a_search_with_bounds_measures_few_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    points, sizes, ids = np.round(rng.normal(size=(600, 6)), 1) + 50, rng.integers(1, 5, size=600).astype(float), np.arange(600) * 2
    plain = linkage._ward(sizes[:, None], sizes[None, :], linkage._squared_gaps(points, points))
    np.fill_diagonal(plain, np.inf)
    middle = points.mean(axis=0)
    search = linkage._Search(ids, sizes, points, middle, linkage._scale_of(float(np.abs(points - middle).max())))
    search.visit(ids[:60], sizes[:60], points[:60])  # no bound yet: this block is measured in double precision
    measured, paired = [], linkage._paired_gaps
    monkeypatch.setattr(linkage, "_closest", None)
    monkeypatch.setattr(linkage, "_paired_gaps", lambda points, row, *rest: measured.append(len(row)) or paired(points, row, *rest))
    for at in range(60, 600, 60):
        search.visit(ids[at : at + 60], sizes[at : at + 60], points[at : at + 60])
    assert (search.distance == plain.min(axis=1)).all() and (search.nearest == ids[plain.argmin(axis=1)]).all()
    assert sum(measured) < 600 * 540 / 10


def test_pairs_over_many_blocks_equal_plain_differences(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 16)
    monkeypatch.setattr(linkage, "CELL_ROWS", 12)
    monkeypatch.setattr(linkage, "PACKED_ROWS", 40)
    monkeypatch.setattr(linkage, "TASK_PAIRS", 1000)
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(90, 3)), 0.01 * rng.normal(size=(60, 3)) + 7])
    gaps = np.sqrt(linkage._squared_gaps(points, points))
    np.fill_diagonal(gaps, np.inf)
    nearest = gaps.argmin(axis=1)
    expected = {(i, int(j), gaps[i, j]) for i, j in enumerate(nearest) if i < j and nearest[j] == i}
    state = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(points)], "cluster bigint, size bigint, centroid array<double>")
    assert {tuple(r) for r in linkage.merge_pairs(state).select("left", "right", "distance").collect()} == expected
    # A place that a third of all share is several blocks.
    packed = linkage._packed(state.withColumn("asks", F.col("cluster") % 2 == 0), 150, linkage._pivots(state, 150)).toPandas()
    assert packed["n"].sum() == 150 and packed["n"].max() <= 12 and packed["n_asks"].sum() == 75
