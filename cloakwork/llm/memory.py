"""Memory of Python workers and of the batches sent to them.

Spark uses a worker again for later stages, so what one task keeps is there in all of them; and a batch of 10,000 rows
of long texts, which is Spark's own bound, takes its size several times over in the JVM and in Python.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not the GNU C library
    _trim = None


def release() -> None:
    """Give what is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy[In, Out](task: Callable[[Iterator[In]], Iterator[Out]], *, then: Callable[[], None] | None = None) -> Callable[[Iterator[In]], Iterator[Out]]:
    """A partition function that calls then() and gives its memory back when its task has ended."""

    @functools.wraps(task)
    def run(batches: Iterator[In]) -> Iterator[Out]:
        try:
            yield from task(batches)
        finally:
            if then:
                then()
            release()

    return run


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES (one row at least), unless the session has set a bound of its own."""
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def map_arrow(table: DataFrame, task, schema: str, then: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow in bounded batches, with memory given back."""
    bound_batches(table.sparkSession)
    return table.mapInArrow(tidy(task, then=then), schema)


def map_pandas(table: DataFrame, task, schema: str, then: Callable[[], None] | None = None) -> DataFrame:
    """mapInPandas in bounded batches, with memory given back."""
    bound_batches(table.sparkSession)
    return table.mapInPandas(tidy(task, then=then), schema)
