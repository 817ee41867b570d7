"""Readers of the flat Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below sf_dir, by Spark's own reader: any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
