"""Arrow batches in slices, so that what a task unpacks at a time stays small, and memory given back between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 512
BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What the setting is where nobody has set it.
_UNSET = "67108864b"
#: Scans of whole texts: what each setting is where nobody has set it, and what it becomes. Fewer rows at a time keep the
#: readers' byte arrays small; vectored reads copy whole row groups through direct buffers, which their threads keep.
SCANS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"), "parquet.hadoop.vectored.io.enabled": ("true", "false")}

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # other C libraries give memory back by themselves
    _trim = None


def give_back() -> None:
    """Returns memory that is free but held by the allocators; workers are reused and would keep it from the next stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and, rows being alike, about `size` bytes; an empty batch as it is."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    batch = None
    give_back()


def bounded(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """build(spark, ...) in a session whose batches to Python workers hold about BYTES, unless it sets another size."""

    @wraps(build)
    def run(spark: SparkSession, *rest) -> DataFrame:
        if spark.conf.get(_BATCH_BYTES, _UNSET) == _UNSET:
            spark.conf.set(_BATCH_BYTES, str(BYTES))
        return build(spark, *rest)

    return run


def lean(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """As bounded, with SCANS too; for chains of stages, whose executors keep what each stage has made them take."""

    @wraps(build)
    def run(spark: SparkSession, *rest) -> DataFrame:
        for name, (unset, value) in SCANS.items():
            if spark.conf.get(name, unset) == unset:
                spark.conf.set(name, value)
        return bounded(build)(spark, *rest)

    return run
