"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlab.llm import words
from cohortlab.session import bound_batches

Batches = Iterator[pa.RecordBatch]


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str, text: str = "text",
             limit: int = words.CHUNK_BYTES) -> DataFrame:
    """Apply ``fn`` to slices of whole rows of about ``limit`` bytes of text; it returns columns by name."""
    bound_batches(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column(text)
            for row, part in words.chunks(column, limit):
                out = fn(batch.slice(row, len(part)))
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(values: object) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def flat_binary(values, first) -> pa.Array:
    """Binary column whose row i holds ``values[first[i]:first[i + 1]]``."""
    width = values.dtype.itemsize
    raw = memoryview(values.tobytes())
    at = (first * width).tolist()
    return pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
