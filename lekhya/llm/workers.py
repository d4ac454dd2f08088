"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


@contextmanager
def with_small_batches(spark: SparkSession):
    """Within, the session hands texts and lists to Python in Arrow batches of a few MB, so what
    both sides hold of them stays small."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
             "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release_memory() -> None:
    """Give back to the system what freed objects and Arrow buffers still hold."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run: Callable) -> Callable:
    """A function for mapInPandas or mapInArrow that leaves its worker small: workers serve later
    stages too, and what each of them keeps adds up."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped
