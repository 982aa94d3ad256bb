from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventgrove.operators.salience import rank_in_document, top_percentile
from eventgrove.plans.ordering import dense_index, group_rank, group_running_sum
from eventgrove.plans.scratch import freeze, shared_dir


@pytest.fixture
def skewed(spark):
    """A third of the rows in one group."""
    rng = random.Random(5)
    rows = [(("hot" if i % 3 == 0 else f"g{i % 40}"), i, rng.randint(0, 30)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, i bigint, v int").repartition(7)


def test_dense_index(skewed):
    rows, df = skewed
    got = dense_index(df, [F.col("v"), F.col("i")], "at").select("at", "i").collect()
    expected = [i for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert [r["i"] for r in sorted(got, key=lambda r: r["at"])] == expected


def test_group_rank(skewed):
    rows, df = skewed
    got = {r["i"]: (r["rank"], r["total"]) for r in group_rank(df, ["g"], [F.col("v").desc(), F.col("i")], "rank", "total").collect()}
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in ordered] == [(k, len(ordered)) for k in range(len(ordered))]


def test_running_sum_over_many_pieces(skewed):
    rows, df = skewed
    got = {r["i"]: r["s"] for r in group_running_sum(df, ["g"], "i", F.col("v"), "s", per_piece=64).collect()}
    totals: dict[str, int] = {}
    for group, i, v in rows:
        assert got[i] == totals.get(group, 0)
        totals[group] = totals.get(group, 0) + v


def test_percentile_bound_is_inclusive(spark):
    rows = spark.createDataFrame([("d", "verb", i, float(i)) for i in range(25)], "doc_id string, kind string, doc_tok_idx int, score double")
    ranked = rank_in_document(rows)
    assert sorted(r["doc_tok_idx"] for r in top_percentile(ranked, 0.1).collect()) == [22, 23, 24]
    assert top_percentile(ranked, None).count() == 25


def test_compat_rank_names_the_ith_best(spark):
    rows = spark.createDataFrame(
        [("d", "verb", 0, 1.0), ("d", "verb", 1, 3.0), ("d", "verb", 2, 2.0)], "doc_id string, kind string, doc_tok_idx int, score double"
    )
    compat = {r["doc_tok_idx"]: r["ranking"] for r in rank_in_document(rows, "compat").collect()}
    assert compat == {0: 1, 1: 2, 2: 0}


def test_frozen_tables_live_in_the_configured_folder(spark, tmp_path):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    assert shared_dir(spark) == shared_dir(other)
    frozen = freeze(spark.range(5), "t")
    assert frozen.count() == 5 and shared_dir(spark) in frozen.inputFiles()[0]


def test_bounds_that_hold_triggers(spark):
    """One document holds nearly all sentences and triggers; gaps, empty sentences and repeats are in it."""
    from eventgrove.operators.prompts import locate_triggers

    n = 30_000
    bounds = [("hot", i, 10 * i + (i % 3), 10 * i + (i % 3) + (0 if i % 11 == 0 else 7)) for i in range(n)] + [("cold", 0, 5, 9), (None, 1, 0, 99)]
    triggers = [("hot", (i * 7919) % (10 * n)) for i in range(n)] + [("hot", 3), ("hot", 3), ("cold", 4), ("cold", 5), ("cold", 9), ("none", 1), (None, 1), ("hot", None)]
    got = locate_triggers(
        spark.createDataFrame(triggers, "doc string, trigger_start int"), spark.createDataFrame(bounds, "doc string, sent int, start int, end int"), "doc"
    )
    want = []
    for doc, at in triggers:
        if doc == "hot" and at is not None:
            for i in (at // 10 - 1, at // 10):
                if 0 <= i < n and bounds[i][2] <= at < bounds[i][3]:
                    want.append((doc, at, i, at - bounds[i][2]))
    want.append(("cold", 5, 0, 0))
    assert sorted((r["doc"], r["trigger_start"], r["sent"], r["local_index"]) for r in got.collect()) == sorted(want)


def test_temporary_tables_go_and_others_stay(spark):
    import os

    from eventgrove.plans.scratch import freeze, scratch_path, temporary_tables

    stays = scratch_path(spark, "stays")
    before = freeze(spark.range(3), "before")
    with temporary_tables(spark):
        inner = freeze(spark.range(5), "inner")
        file = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(file)
        inner.write.parquet(stays)
    assert not os.path.exists(os.path.dirname(file))
    assert spark.read.parquet(stays).count() == 5 and before.count() == 3
