from __future__ import annotations

import pytest

from tests.llm import brute

#: Columns that documents do not have, with names that the operators use themselves.
CLASHES = "row string, at int, k1 int, tokens string, score string, batch int, ids string, token string, kept int, N_TOKENS int"


@pytest.fixture(scope="session")
def documents(spark):
    """Odd documents with clashing extra columns: nulls, empties, repeats, long and periodic texts."""
    langs, sources = ("en", "fr", None), ("src0", "src1", "odd", None)
    rows = [(i, t, langs[k % 3], sources[k % 4], len(t or ""), "r", 1, 2, "t", "s", 3, "i", "k", 4, 5) for k, (i, t) in enumerate(brute.corpus())]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)
