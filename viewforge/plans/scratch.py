"""Written intermediate tables: lineage is cut at shared, replicated storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    context.setCheckpointDir(tempfile.mkdtemp(prefix="viewforge-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, tag: str, *folders: str) -> DataFrame:
    """Writes df to a Parquet table in the shared folder, with folders for these columns' values, and returns a scan of it.

    The table survives the loss of any executor. It stays until discard() or the end of
    a passing() block removes it, or the checkpoint folder is emptied, because a lazy
    result may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/viewforge/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    for scope in _SCOPES:
        scope.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


_SCOPES: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Removes the table behind what materialise() returned, all of whose readers have run."""
    _remove(df.sparkSession, df.scratch_path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written in the block go at its end, but for those that the yielded function was given."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
    for path in made:
        if path not in kept:
            _remove(spark, path)


def small_side(df: DataFrame, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """df with a broadcast hint if its counted rows fit limit_bytes, else df as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df
