"""The driver's contract, and a few whole queries against their SQL at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[:2] == ["doc_id", "sent_id"] and frame.count() > 0


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@needs_data
@pytest.mark.parametrize(
    "name", ["b13_predicate_argument_graph", "c6_rank_in_document", "c11_salient_events", "d6_lookup_sense", "e9_rollup_distribution", "f14_attach_event_types"]
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = con.sql(contract.oracle_sql()[name])
    columns = sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    want = sorted(repr([plain(row[i]) for i in at]) for row in expected.fetchall())
    frame = contract.queries()[name](spark, FOLDER)
    assert sorted(frame.columns) == columns
    assert sorted(repr([plain(row[c]) for c in columns]) for row in frame.collect()) == want
