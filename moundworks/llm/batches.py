"""Small helpers for Arrow batches inside tasks."""

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from moundworks.sources.store import ship_package

#: Bytes of text that one numpy step holds at once. A longer text is one step of its own.
STEP_BYTES = 1 << 20


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from step(batch)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_steps(batch: pa.RecordBatch, column: str, max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into zero-copy slices of about ``max_bytes`` of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


def records(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the schema's columns, each from a list or array."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in schema],
        schema=schema,
    )
