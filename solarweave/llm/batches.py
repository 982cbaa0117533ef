"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def give_back() -> None:
    """Return what a task no longer uses to the system: the worker lives on, for tasks of other stages.

    Arrow's pool and the C allocator keep freed memory otherwise, so a worker would hold the
    greatest need of all stages that it ever ran.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not a GNU C library
        pass


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column's values; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of text that become Python objects at once.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """batch in slices whose text is at most most bytes, or one row; memory doesn't grow with Spark's batches."""
    size = np.full(batch.num_rows, 64, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    for a, b in spans(size.tolist(), most):
        yield batch.slice(a, b - a)


#: Rows of one Arrow batch, where the session doesn't say: documents are long, and executors hold a batch in several forms at once.
ROWS = 1000


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, with batches of ROWS rows unless the session has its own setting."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(ROWS))
    return df.mapInArrow(run, schema)


def by_batch(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """df through a function of Arrow batches that returns columns by name; start() runs once a task."""
    fields = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, each = to_arrow_schema(fields), start()
        for batch in (p for b in batches for p in pieces(b)):
            columns = each(batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, out.field(n).type) for n, c in ((f.name, columns[f.name]) for f in out)], schema=out)
        each = columns = batch = None
        give_back()

    return in_batches(df, run, fields)


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most most, or hold one item."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
