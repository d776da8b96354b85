"""Arrow batches whose size is bounded by bytes, for functions that run over whole texts.

Spark fills a batch up to 10,000 rows or 64 MB, and the JVM's and the worker's buffers of it
are kept for later ones. Here the session's limit is lowered to ``BATCH_BYTES`` (a smaller
one stays), a function sees runs of rows of about ``SLICE_BYTES`` bytes of text (a longer
text is a run of its own), all other columns pass through untouched, and workers, which
Spark reuses, hand freed memory back when a task ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Return memory that Arrow and the C library keep for later to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it decides itself


def limit_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, for plans made from now on."""
    now = spark.conf.get(_LIMIT).lower().rstrip("b")
    # A value in other units was set by the user.
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(_LIMIT, f"{BATCH_BYTES}b")


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of ``column``, text or binary; null counts nothing."""
    for batch in batches:
        held = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(held.to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def tidy(rows: Callable) -> Callable:
    """``rows``, a function over batches, with its memory handed back when a task ends."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def map_slices(df: DataFrame, column: str, rows: Callable, made: str) -> DataFrame:
    """``df.mapInPandas(rows, made)``, with frames of about ``SLICE_BYTES`` bytes of ``column``."""
    limit_batches(df.sparkSession)
    schema = StructType.fromDDL(made)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for pdf in rows(part.to_pandas() for part in byte_slices(batches, column)):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, column: str, made: str, compute: Callable[[pa.Array], Sequence[pa.Array]]) -> DataFrame:
    """Add the columns of the schema string ``made``, computed from the values of ``column``.

    ``compute`` takes the values of a run of rows, an Arrow array, and returns one Arrow array
    per new column. Columns of the same names are replaced.
    """
    limit_batches(df.sparkSession)
    new = StructType.fromDDL(made)
    names = new.names
    rest = [c for c in df.columns if c not in names]
    source = "_column"
    while source in df.columns or source in names:
        source += "_"
    schema = StructType([*df.select(*rest).schema.fields, *new.fields])

    def run(batches):
        for part in byte_slices(batches, source):
            arrays = [part.column(c) for c in rest] + list(compute(part.column(source)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *names])

    return df.select(*rest, df[column].alias(source)).mapInArrow(run, schema)
