"""Python steps whose memory is bounded by a row, not by a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FRAME_ROWS, FRAME_BYTES = 2_000, 4_000_000  # a frame goes out when it holds one of them


def weight(value) -> int:
    """About the bytes a value takes."""
    if isinstance(value, (str, bytes)):
        return 50 + len(value)
    if isinstance(value, dict):
        return 100 + sum(map(weight, value.values()))
    if isinstance(value, (list, tuple)):
        return 60 + sum(map(weight, value))
    return 16


def frames(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``FRAME_ROWS`` rows and about ``FRAME_BYTES`` bytes; a single larger row is a batch of its own."""
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= FRAME_ROWS or size >= FRAME_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def values_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches as Python values, one row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def map_rows(df: DataFrame, of_row: Callable[..., Iterable[tuple]], ddl: str, schema: pa.Schema) -> DataFrame:
    """``of_row(*values)`` gives any number of rows for each row of ``df``; ``schema`` is ``ddl`` in Arrow's types."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from frames((out for values in values_of(batches) for out in of_row(*values)), schema)

    return df.mapInArrow(run, ddl)
