"""Arrow batches of documents in pieces of bounded bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Batches to batches, and the columns that come out.
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: From the columns that go in.
Step = Callable[[T.StructType], tuple[Run, T.StructType]]
#: Rows and bytes of documents that a Python step works on at once; a larger document is a piece by itself. A tree takes
#: some hundred times its text.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20
#: Rows and bytes that Spark hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) != f"{BATCH_BYTES}b":
        spark.conf.set(size, f"{BATCH_BYTES}b")


def through(df: DataFrame, *steps: Step) -> DataFrame:
    """df through all steps in one Python worker: several Python operators in a row would hold a worker each for a task."""
    small_batches(df.sparkSession)
    runs, schema = [], df.schema
    for step in steps:
        run, schema = step(schema)
        runs.append(run)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs:
            batches = run(batches)
        return batches

    return df.mapInArrow(run_all, schema)


def picking(columns: list[str], keep: Callable[[pa.RecordBatch], pa.Array] | None = None) -> Step:
    """The columns named, of the rows to keep."""

    def step(schema: T.StructType) -> tuple[Run, T.StructType]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield (batch if keep is None else batch.filter(keep(batch))).select(columns)

        return run, T.StructType([schema[c] for c in columns])

    return step


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on between tasks."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, by the length of a text or binary column: memory follows the longest document."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column if column >= 0 else batch.num_columns + column)), 0)
        ends, start = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + PIECE_BYTES))), start + PIECE_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    trim()
