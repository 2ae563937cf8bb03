"""One image a row through numpy: no shuffle, a bounded piece of rows in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a task holds as arrays of its own at once, one image at least: less than a full batch of small images has, so
#: that a worker's memory doesn't follow the rows of a task.
PIECE = 1 << 16


def pieces(batches: Iterator[pa.RecordBatch], column: str = "values", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut, without a copy, so that the arrays in a piece's column have about `limit` values together."""
    for batch in batches:
        sizes = np.diff(batch.column(column).offsets.to_numpy())
        at = 0
        for n in np.unique(np.cumsum(sizes, dtype=np.int64) // limit, return_counts=True)[1].tolist():
            yield batch.slice(at, n)
            at += n


def arrays(batch: pa.RecordBatch, column: str = "values") -> list[np.ndarray]:
    """A column of lists as numpy views of Arrow's own memory."""
    held = batch.column(column)
    values, bounds = held.values.to_numpy(zero_copy_only=False), held.offsets.to_numpy()
    return [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shapes(batch: pa.RecordBatch, columns: str = "dhw") -> list[tuple[int, ...]]:
    return list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))


def listed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def dense(stack: DataFrame, function) -> DataFrame:
    """Each image (a 3-d array of double) through function, in the same shape; one row at a time, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [function(np.array(v, np.float64).reshape(s)).ravel() for v, s in zip(arrays(batch), shapes(batch), strict=True)]
            columns = [listed(found) if c == "values" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return stack.mapInArrow(run, stack.schema)


def scatter(entries: DataFrame, size: int, parts: tuple[str, ...], core: list[str]) -> DataFrame:
    """Rows with `entries` (an array of structs: place and parts) as dense arrays of `size`, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "entries"):
            held = batch.column("entries")
            out = {p: [] for p in parts}
            for k in range(len(held)):
                row = held[k].values
                place = row.field("place").to_numpy(zero_copy_only=False)
                for p in parts:
                    values = np.zeros(size)
                    values[place] = row.field(p).to_numpy(zero_copy_only=False)
                    out[p].append(values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in core), *(listed(v) for v in out.values())], [*core, *parts])

    schema = entries.select(*core, *[F.expr("cast(array() as array<double>)").alias(p) for p in parts]).schema
    return entries.select(*core, "entries").mapInArrow(run, schema)
