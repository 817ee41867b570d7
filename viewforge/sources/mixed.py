"""Scans of folders that hold several formats, and of run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewforge.operators.assemble import union_all

FORMATS = (("json", "*.jsonl"), ("json", "*.json"), ("parquet", "*.parquet"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that there is."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(" or ".join(paths))


def mixed_scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all JSON lines, JSON and Parquet files below path; columns that a format lacks are null."""
    found = []
    for name, pattern in FORMATS:
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        if pattern == "*.json":
            reader = reader.option("multiLine", "true")
        glob = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        if not glob.select("path").isEmpty():
            found.append(reader.format(name).load(path))
    if not found:
        raise FileNotFoundError(path)
    return union_all(*found)


RUN_LOG = "event string, step bigint, examples_seen bigint, tokenized_examples bigint, seq_len int, batch_s double, loader_s double, step_s double, examples_per_s double, tokens_per_s double"


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """A run's log of JSON lines."""
    return spark.read.schema(RUN_LOG).json(path)
