"""Splits of labelled benchmarks on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewforge.sources.mixed import first_existing
from viewforge.sources.normalise import labelled_rows

FILES = {"train": "train.jsonl", "validation": "valid.jsonl", "test": "test.jsonl"}


def labelled_splits(spark: SparkSession, base: str, caps: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The three splits below base or its folder `dataset`; caps hold for validation and test alone."""
    caps = caps or {}
    found = {split: first_existing(spark, f"{base}/{name}", f"{base}/dataset/{name}") for split, name in FILES.items()}
    return {split: labelled_rows(spark, path, caps.get(split, 0) if split != "train" else 0) for split, path in found.items()}
