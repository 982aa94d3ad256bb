"""Small helpers shared by the operators: column replacement and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 2 << 20


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``limit`` bytes (elements of an array) of ``column`` each; one longer value makes a slice of its own."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        sizes = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
        for i, size in enumerate(sizes.to_pylist()):
            size = size or 0
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def with_arrow_columns(
    df: DataFrame, text: str, fields: dict[str, T.DataType], compute: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None, limit: int = BATCH_BYTES
) -> DataFrame:
    """``df`` (or its columns ``keep``) with new columns that ``compute`` makes from the column ``text``.

    Columns that already have a new name are replaced, as ``withColumn`` does. The work is row-local:
    a lost task is run again, and memory is bounded by one sub-batch.
    """
    names = list(fields)
    replaced = {n.lower() for n in names}
    others = [c for c in (df.columns if keep is None else keep) if c.lower() not in replaced]
    source = text if text in others else "_eg_in"  # a text that stays crosses to Python once
    kept = df.select(*others) if source == text else df.select(*others, F.col(text).alias(source))
    stays = [f for f in kept.schema.fields if f.name in others]
    schema = T.StructType([*stays, *(T.StructField(n, t) for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, source, limit):
            at = batch.schema.get_field_index(source)
            made = compute(batch.column(at))
            held = batch.columns[: len(stays)]
            yield pa.RecordBatch.from_arrays([*held, *made], names=[*(f.name for f in stays), *names])

    return kept.mapInArrow(run, schema)
