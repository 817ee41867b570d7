"""File rows: identity, size, filters, windows, deduplication and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.functions import text as T
from viewforge.operators.ranking import first_per_key, running


def as_source_files(docs: DataFrame, dataset: str = "documents") -> DataFrame:
    """documents as source files: the source is the repository, the identifier the path."""
    return docs.select(
        F.lit(dataset).alias("dataset_key"),
        F.lit(dataset).alias("source_dataset"),
        F.lit("train").alias("source_split"),
        F.col("doc_id").cast("long").alias("source_row_index"),
        F.coalesce("source", F.lit("")).alias("repository_name"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.coalesce("lang", F.lit("")).alias("language"),
        F.coalesce("text", F.lit("")).alias("source"),
    )


def file_profile(files: DataFrame) -> DataFrame:
    """Identity, split and size of every source file."""
    code = T.closed(F.col("source"))
    rows = files.withColumns({"code": code, "loc": T.line_count(code)})
    file_hash = T.stable_hash(F.col("repository_name"), F.col("path"), F.col("code"))
    file_id = T.stable_hash(F.col("dataset_key"), F.col("repository_name"), F.col("path"), F.col("file_hash"))
    key = F.coalesce(F.nullif("repository_name", F.lit("")), F.nullif("path", F.lit("")), F.col("file_id"))
    return (
        rows.withColumn("file_hash", file_hash)
        .withColumn("file_id", file_id)
        .select(
            "source_row_index",
            "file_id",
            T.hash_split(key).alias("split"),
            "repository_name",
            "path",
            "language",
            F.length("code").cast("long").alias("char_len"),
            F.col("loc").cast("long").alias("loc"),
            T.token_count(F.col("code")).cast("long").alias("rough_token_len"),
            T.size_bucket(F.col("loc")).alias("size_bucket"),
            T.sampling_weight(F.col("loc")).alias("sampling_weight"),
        )
    )


def split_bucket_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("split", "size_bucket").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("rough_token_len").alias("tokens"))


def file_windows(files: DataFrame, window_lines: int = 120, stride: int = 80, most: int = 8) -> DataFrame:
    """Overlapping line windows of files that have at least window_lines lines."""
    rows = files.withColumn("__lines", T.lines(T.closed(F.col("source")))).filter(F.size("__lines") >= window_lines)
    starts = F.sequence(F.lit(0), F.size("__lines") - 1, F.lit(stride))
    cut = rows.select("*", F.posexplode(starts).alias("window_index", "__start"))
    stop = F.least(F.size("__lines"), F.col("__start") + window_lines)
    cut = cut.withColumns({"code": T.closed(F.array_join(F.slice("__lines", F.col("__start") + 1, stop - F.col("__start")), "\n")), "start_line": F.col("__start") + 1, "end_line": stop})
    cut = cut.filter(F.col("code").rlike(T.NOT_SPACE))
    # blank windows don't count against the cap
    ordinal = F.row_number().over(_by(["source_row_index"], "window_index"))
    return cut.withColumn("__n", ordinal).filter(F.col("__n") <= most).drop("__n", "__lines", "__start", "source")


def _by(keys: list[str], *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def reject_reasons(files: DataFrame, most_chars: int = 200_000, least_tokens: int = 16, min_loc: int = 3, max_loc: int = 250) -> DataFrame:
    """files with the first rule that rejects each, or `kept`."""
    source = F.col("source")
    loc = T.line_count(source)
    reason = (
        F.when(~source.rlike(T.NOT_SPACE), "skipped_empty")
        .when(F.length(source) > most_chars, "skipped_too_large")
        .when(T.token_count(source) < least_tokens, "skipped_too_small")
        .when((loc < min_loc) | (loc > max_loc), "skipped_loc")
        .otherwise("kept")
    )
    return files.withColumn("reason", reason)


def distinct_first(files: DataFrame, by: Column, order: str = "source_row_index") -> DataFrame:
    """The first row for each value of by."""
    return first_per_key(files.withColumn("__key", by), ["__key"], [order]).drop("__key")


def capped(files: DataFrame, keys: list[str], cap: int, order: str = "source_row_index") -> DataFrame:
    """At most cap rows for each of keys, the first ones."""
    return files.withColumn("__n", F.row_number().over(_by(keys, order))).filter(F.col("__n") <= cap).drop("__n")


def token_budget(files: DataFrame, budget: int, order: str = "source_row_index") -> DataFrame:
    """The leading rows until their tokens reach budget; the row that reaches it is the last.

    order names each row. Only it and the counts are written and ranged; the rows that
    remain are joined back.
    """
    sizes = files.select(order, T.token_count(F.col("source")).cast("long").alias("tokens"))
    counted = running(sizes, [F.col(order)], {"__sum": F.col("tokens")}).select(order, "tokens", (F.col("__sum") - F.col("tokens")).cast("long").alias("tokens_before"))
    return files.join(counted.filter(F.col("tokens_before") < budget), order)


def retrieval_rows(pairs: DataFrame, query: str, code: str, order: str, n: int, least_query: int = 3, least_code: int = 8, least_rows: int = 0) -> DataFrame:
    """The first n rows with enough words in query and code, each code once; an error if there are fewer than least_rows."""
    rows = pairs.withColumns({"query": T.strip(F.coalesce(F.col(query), F.lit(""))), "code": T.strip(F.coalesce(F.col(code), F.lit("")))})
    rows = rows.filter((T.token_count(F.col("query")) >= least_query) & (T.token_count(F.col("code")) >= least_code))
    found = first_per_key(rows.select(order, "query", "code"), ["code"], [order]).orderBy(order).limit(n)
    if least_rows and len(found.select(order).head(least_rows)) < least_rows:
        raise ValueError(f"fewer than {least_rows} usable rows")
    return found


def intern_texts(rows: DataFrame, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Dense identifiers of distinct texts in order of their first row; and each row's."""
    digests = rows.select(F.col(order), F.sha1(F.coalesce(text, F.lit(""))).alias("digest"))
    first = digests.groupBy("digest").agg(F.min(order).alias("first_row"))
    numbered = running(first, [F.col("first_row"), F.col("digest")]).select("digest", "first_row", (F.col("rn") - 1).alias("idx"))
    return numbered, digests.join(numbered, "digest").select(order, "idx")
