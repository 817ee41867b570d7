"""Makes this package importable in Python workers that don't share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless workers find it anyway."""
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or any(p and Path(p).resolve() == ROOT for p in paths):
        return
    # the driver's file server hands the archive out, so its own place doesn't matter
    archive = Path(tempfile.mkdtemp(prefix="viewforge-")) / "viewforge.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in [*(ROOT / "viewforge").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
            if source.exists():
                out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
