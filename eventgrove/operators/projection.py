"""A linear projection fitted on the table itself: principal axes by randomised block iteration.

Each pass multiplies a block of directions by the rows' covariance: a task adds up x (x . Q) over its rows,
and the sums of tasks are added in a tree, so what moves is one matrix of (width x directions) per task and
the driver sees one. No pass holds a (width x width) matrix, and no row leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventgrove.functions.vectors import as_double

#: Directions beyond those asked for, which make the iteration converge.
EXTRA = 8


@dataclass(frozen=True)
class Projection:
    """``mean`` (width), ``axes`` (kept x width, orthonormal) and ``variances`` of the rows along the axes."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    rows: int


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(0)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum of ``part(rows)`` over blocks of rows, added per task, then in a tree; null for an empty table."""

    def add(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = read(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["sum", "shape"])

    def one(row: dict) -> np.ndarray:
        return np.frombuffer(row["sum"], dtype=np.float64).reshape(row["shape"])

    layout = "sum binary, shape array<int>"
    parts = vectors.mapInArrow(lambda batches: add(batches, lambda b: part(_matrix(b))), layout)
    level = lambda df: df.mapInArrow(lambda batches: add(batches, lambda b: np.sum([one(r) for r in b.to_pylist()], axis=0)), layout)
    groups = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    row = level(level(parts.repartition(groups)).coalesce(1)).first()
    return None if row is None else one(row.asDict())


def fit_projection(df: DataFrame, k: int, vector: str = "features", passes: int = 8, seed: int = 0) -> Projection:
    """The ``k`` principal axes of the rows' vectors; null vectors are left out, all others have one width.

    ``passes`` block iterations read the table; each is one job. The result depends on the rows and the
    seed, up to the order in which sums are added. An empty table cannot be fitted.
    """
    vectors = df.select(as_double(F.col(vector)).alias("v")).where("v is not null")
    first = summed(vectors, lambda x: np.vstack([x.sum(axis=0), np.full(x.shape[1], len(x))]))
    if first is None:
        raise ValueError("no vectors to fit")
    rows = int(first[1, 0])
    mean = first[0] / rows
    width = len(mean)
    k = min(k, width)
    block = np.random.default_rng(seed).normal(size=(width, min(width, k + EXTRA)))
    for _ in range(passes):
        q, _ = np.linalg.qr(block)
        block = summed(vectors, lambda x, q=q: (x - mean).T @ ((x - mean) @ q))
    q, _ = np.linalg.qr(block)
    inner = summed(vectors, lambda x: ((x - mean) @ q).T @ ((x - mean) @ q))
    values, turn = np.linalg.eigh(inner)
    order = np.argsort(-values)[:k]
    axes = (q @ turn[:, order]).T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return Projection(mean, axes * signs[:, None], values[order] / rows, rows)


def apply_projection(df: DataFrame, projection: Projection, vector: str = "features") -> DataFrame:
    """``df`` with the vector's coordinates along the axes in its place; null stays null. Row-local."""
    rows = df.withColumn(vector, as_double(F.col(vector)))
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == vector else f for f in rows.schema.fields])
    mean, axes = projection.mean, projection.axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(vector)
        for batch in batches:
            column = batch.column(at)
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            x = np.array([column[int(i)].as_py() for i in there], dtype=np.float64).reshape(len(there), len(mean))
            out: list = [None] * len(column)
            for i, y in zip(there, ((x - mean) @ axes.T).tolist()):
                out[i] = y
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
