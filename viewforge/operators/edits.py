"""Single edits over columns of program text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from viewforge.code import languages as L
from viewforge.code import textedits


def text_edit(files: DataFrame, name: str) -> DataFrame:
    """source_row_index and code of the files (source, language) that the named edit changes.

    The edit alone decides; whether the result is balanced isn't looked at.
    """
    edit = next(e for e in textedits.EDITS if e.name == name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for index, source, language in zip(pdf["source_row_index"], pdf["source"], pdf["language"], strict=True):
                changed = edit.change(source, L.LANGUAGES[language])
                new = changed[0] if isinstance(changed, tuple) else changed
                if new is not None and new.strip() != source.strip():
                    out.append((index, new.rstrip() + "\n"))
            if out:
                yield pd.DataFrame(out, columns=["source_row_index", "code"])

    return files.select("source_row_index", "source", "language").mapInPandas(run, "source_row_index long, code string")
