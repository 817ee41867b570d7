"""Rows of public corpora as source files and tasks.

Where a corpus gives several columns for one thing, the first that holds something
counts. Columns that a table lacks are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.functions import text as T
from viewforge.operators.ranking import running
from viewforge.operators.tasks import class_language, task_language

SPLITS = ("train", "validation", "test")


def chosen_splits(wanted: tuple[str, ...], there: tuple[str, ...] = SPLITS) -> list[str]:
    """The splits wanted in canonical order; `all` means all."""
    return [s for s in there if "all" in wanted or s in wanted]


def _column(rows: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the columns that holds other than null and the empty string."""
    there = [F.nullif(F.col(n).cast(kind), F.lit("").cast(kind)) if kind == "string" else F.col(n).cast(kind) for n in names if n in rows.columns]
    return F.coalesce(*there, F.lit(None).cast(kind)) if there else F.lit(None).cast(kind)


def numbered(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """rows with row_index from 0: in the order of the named columns, or as read."""
    if "row_index" in rows.columns:
        return rows
    if order:
        return running(rows, [F.col(c) for c in order], rank="row_index").withColumn("row_index", F.col("row_index") - 1)
    return rows.withColumn("row_index", F.monotonically_increasing_id())


def _source_files(rows: DataFrame, dataset: str, origin: Column, split: str, repository: Column, path: Column, language: Column, source: Column, metadata: Column) -> DataFrame:
    return rows.select(
        F.lit(dataset).alias("dataset_key"),
        origin.alias("source_dataset"),
        F.lit(split).alias("source_split"),
        F.col("row_index").cast("long").alias("source_row_index"),
        F.coalesce(repository, F.lit("")).alias("repository_name"),
        path.alias("path"),
        language.alias("language"),
        source.alias("source"),
        metadata.alias("metadata_json"),
    ).filter(F.col("source").rlike(T.NOT_SPACE))


def whole_files(rows: DataFrame, split: str = "train", order: list[str] | None = None) -> DataFrame:
    """Rows of whole Python files: content, repo_name, path, license, hash, autogenerated, size."""
    rows = numbered(rows, order)
    path = F.coalesce(_column(rows, "path"), F.concat(F.lit("row-"), F.col("row_index").cast("string"), F.lit(".py")))
    metadata = F.to_json(F.struct(_column(rows, "autogenerated").alias("autogenerated"), _column(rows, "hash").alias("hash"), _column(rows, "license").alias("license"), _column(rows, "size").alias("size")), {"ignoreNullFields": "false"})
    return _source_files(rows, "codeparrot_clean_python", F.lit("codeparrot/codeparrot-clean"), split, _column(rows, "repo_name"), path, F.lit("python"), _column(rows, "content"), metadata)


def functions(rows: DataFrame, language: str = "", split: str = "train", dataset: str = "codesearchnet", order: list[str] | None = None) -> DataFrame:
    """Rows of single functions with their documentation."""
    rows = numbered(rows, order)
    index = F.col("row_index").cast("string")
    name = F.lit(language) if language else F.coalesce(_column(rows, "language"), F.lit(""))
    path = F.coalesce(_column(rows, "func_path_in_repository"), F.concat(F.lit("row-"), index, F.lit("."), name))
    fields = {"documentation": "func_documentation_string", "func_code_url": "func_code_url", "split_name": "split_name"}
    metadata = F.to_json(
        F.struct(
            *(_column(rows, column).alias(key) for key, column in fields.items()),
            F.coalesce(_column(rows, "func_name"), F.concat(F.lit("function_"), index)).alias("func_name"),
        ),
        {"ignoreNullFields": "false"},
    )
    source = T.closed(_column(rows, "whole_func_string", "func_code_string"))
    return _source_files(rows, dataset, F.concat(F.lit("code_search_net/"), name), split, _column(rows, "repository_name"), path, name, source, metadata)


_SOLUTION = "array<struct<language:string,code:string,solution_id:string>>"


def _tasks(rows: DataFrame, task_id: Column, split: str, prompt: Column, solutions: Column, metadata: Column | None = None) -> DataFrame:
    out = rows.select(task_id.cast("string").alias("task_id"), F.lit(split).alias("split"), F.coalesce(prompt, F.lit("")).alias("prompt"), solutions.cast(_SOLUTION).alias("solutions"), (F.lit("{}") if metadata is None else metadata).alias("metadata_json"))
    return out.filter(F.size("solutions") > 0)


def _one(code: Column) -> Column:
    """A single Python solution, none if code is blank."""
    made = F.array(F.struct(F.lit("python").alias("language"), code.alias("code"), F.lit("0").alias("solution_id")))
    return F.when(code.rlike(T.NOT_SPACE), made).otherwise(F.array().cast(_SOLUTION))


def humaneval(rows: DataFrame, split: str = "test") -> DataFrame:
    rows = numbered(rows)
    prompt = F.coalesce(_column(rows, "prompt"), F.lit(""))
    code = F.concat(prompt, F.coalesce(_column(rows, "canonical_solution"), F.lit("")))
    return _tasks(rows, F.coalesce(_column(rows, "task_id"), F.col("row_index").cast("string")), split, prompt, _one(code))


def mbpp(rows: DataFrame, split: str = "test") -> DataFrame:
    rows = numbered(rows)
    return _tasks(rows, F.coalesce(_column(rows, "task_id", "id"), F.col("row_index").cast("string")), split, _column(rows, "text", "prompt"), _one(F.coalesce(_column(rows, "code"), F.lit(""))))


def apps(rows: DataFrame, split: str = "train") -> DataFrame:
    """solutions is a JSON array of programs; what isn't a text, or blank, goes."""
    rows = numbered(rows)
    codes = F.from_json(_column(rows, "solutions"), "array<string>")
    made = F.transform(codes, lambda code, i: F.struct(F.lit("python").alias("language"), code.alias("code"), i.cast("string").alias("solution_id")))
    kept = F.filter(F.coalesce(made, F.array().cast(_SOLUTION)), lambda s: F.coalesce(s["code"].rlike(T.NOT_SPACE), F.lit(False)))
    return _tasks(rows, F.coalesce(_column(rows, "problem_id", "id"), F.col("row_index").cast("string")), split, _column(rows, "question"), kept)


def codecontests(rows: DataFrame, split: str = "train") -> DataFrame:
    """solutions is a struct of parallel arrays: language (class numbers or names) and solution."""
    rows = numbered(rows)
    kind = rows.schema["solutions"].dataType["language"].dataType.elementType.simpleString()
    numbers = kind in ("tinyint", "smallint", "int", "bigint")

    def entry(code: Column, i: Column) -> Column:
        named = F.coalesce(F.get(F.col("solutions.language"), i).cast("string"), F.lit(""))
        language = class_language(named.try_cast("int"), True) if numbers else F.when(named == "", task_language(F.lit(None).cast("string"))).otherwise(class_language(named, False))
        return F.struct(F.coalesce(language, F.lit("unknown")).alias("language"), T.closed(code).alias("code"), i.cast("string").alias("solution_id"))

    made = F.filter(F.transform(F.col("solutions.solution"), entry), lambda s: s["code"].rlike(T.NOT_SPACE))
    return _tasks(rows, F.coalesce(_column(rows, "name"), F.col("row_index").cast("string")), split, _column(rows, "description"), F.coalesce(made.cast(_SOLUTION), F.array().cast(_SOLUTION)))


def raw_pairs(rows: DataFrame, least_doc: int = 3, least_code: int = 8) -> DataFrame:
    """code and doc of rows that hold enough of both, under any of their usual names."""
    code = T.strip(_column(rows, "code", "whole_func_string", "func_code_string"))
    doc = T.strip(_column(rows, "docstring", "func_documentation_string", "doc"))
    out = rows.select(code.alias("code"), doc.alias("doc"))
    return out.filter((T.token_count(F.col("code")) >= least_code) & (T.token_count(F.col("doc")) >= least_doc))


def pair_file(spark, path: str) -> DataFrame:
    """left, right and label from lines of three words; other lines go."""
    parts = F.split(T.strip(F.col("value")), T.SPACE + "+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 3)
    return rows.select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right"), F.col("p")[2].try_cast("int").alias("label")).filter("label is not null")


def labelled_rows(spark, path: str, cap: int = 0) -> DataFrame:
    """code and label of JSON lines that hold both, at most cap of them if cap isn't 0."""
    rows = spark.read.json(path).select(F.col("code").cast("string"), F.col("label").cast("string")).dropna()
    return rows.limit(cap) if cap else rows


def function_map(spark, path: str) -> DataFrame:
    """idx and code of JSON lines of functions."""
    return spark.read.json(path).select(F.col("idx").cast("string").alias("idx"), F.col("func").alias("code")).dropna()
