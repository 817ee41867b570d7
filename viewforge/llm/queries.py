"""Registry of the queries of this subpackage and of their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from viewforge.llm.batches import bounded

MODULES = (
    "packing",
    "exact_dedup",
    "byte_bpe",
    "token_counts",
    "repeats",
    "jaccard_join",
    "pivot_index",
    "html_text",
    "toxicity",
    "quality",
)


def _loaded() -> list:
    return [importlib.import_module(f"viewforge.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable]:
    """Query name to (spark, sf_dir) -> DataFrame."""
    return {module.QUERY: bounded(module.query) for module in _loaded()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, where SQL can express the query."""
    return {module.QUERY: module.ORACLE_SQL for module in _loaded() if getattr(module, "ORACLE_SQL", None)}
