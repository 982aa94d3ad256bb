from __future__ import annotations

import pytest

from eventgrove.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions on one row of named values: ``one(schema, values, column)``."""

    def run(schema, values, column):
        return spark.createDataFrame([tuple(values)], schema).select(column.alias("out")).first()["out"]

    return run
