"""Helpers for Arrow-batched tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from moodfeed.llm.ship import ship

#: Text bytes that one call of a task function gets, unless a single text is longer.
SLICE_BYTES = 1 << 19


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets in them; null counts as empty."""
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(binary, pa.ChunkedArray):
        binary = binary.combine_chunks()
    offsets = np.frombuffer(binary.buffers()[1], np.int64)
    offsets = offsets[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``limit`` bytes of text; one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(lengths, np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def annotate(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[pa.Array], pa.Array]],
    dtype: T.DataType,
    name: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """All columns of ``df`` and one more, computed from a text column slice by slice.

    ``make`` is called once a task and returns the function of a slice.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, dtype)])
    names = schema.names
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            # positions, as other columns may repeat a name
            plain = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in slices(plain, f"c{at}", limit):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, function(part.column(at))], names=names
                )

    return df.mapInArrow(run, schema)
