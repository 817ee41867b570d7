"""Task solutions and the pairs of solutions to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewforge.functions import text as T

#: Names of languages as task corpora write them, and class numbers.
TASK_ALIASES = {"py": "python", "python3": "python", "python 3": "python", "python 2": "python2", "cpp": "cpp", "cxx": "cpp"}
CLASS_LABELS = {0: "unknown", 1: "python2", 2: "cpp", 3: "python", 4: "java"}
CLASS_NAMES = {"unknown_language": "unknown", "python": "python2", "cpp": "cpp", "python3": "python", "java": "java"}
#: Names of languages on a command line.
CLI_ALIASES = {"js": "javascript", "node": "javascript", "golang": "go", "py": "python", "python3": "python"}


def _mapped(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value)


def task_language(value: Column) -> Column:
    """The canonical name of a task's language."""
    name = F.lower(T.strip(F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))))
    return _mapped(F.replace(name, F.lit("++"), F.lit("pp")), TASK_ALIASES)


def cli_language(value: Column) -> Column:
    return _mapped(F.lower(T.strip(value)), CLI_ALIASES)


def class_language(value: Column, numbers: bool = True) -> Column:
    """The language behind a class number, or with numbers=False behind a class name."""
    if numbers:
        labels = F.create_map(*(F.lit(x) for pair in CLASS_LABELS.items() for x in pair))
        return F.coalesce(F.element_at(labels, value.cast("int")), value.cast("string"))
    names = F.create_map(*(F.lit(x) for pair in CLASS_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.lower(value)), task_language(value))


def unique_solutions(solutions: DataFrame, most: int = 32) -> DataFrame:
    """solutions (task_id, solution_index, language, code) without repeats, languages in turn, at most `most` a task.

    Adds position, the place in that order from 0.
    """
    rows = solutions.withColumns({"language": task_language(F.col("language")), "code": T.strip(F.coalesce("code", F.lit("")))}).filter("code <> ''")
    rows = rows.groupBy("task_id", "language", "code").agg(F.min("solution_index").alias("solution_index"))
    turn = F.row_number().over(Window.partitionBy("task_id", "language").orderBy("solution_index"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("turn", "language"))
    rows = rows.withColumn("turn", turn).filter(F.col("turn") <= most).withColumn("position", place - 1)
    return rows.filter(F.col("position") < most).withColumn("code", F.concat("code", F.lit("\n"))).drop("turn")


def semantic_pairs(solutions: DataFrame, most: int = 256) -> DataFrame:
    """Pairs of a task's unique solutions (task_id, position, language), the first `most` in lexicographic order.

    A task has at most as many solutions as unique_solutions lets through, so the pairs
    of one task are bounded.
    """
    left = solutions.select("task_id", *(F.col(c).alias(f"left_{c}") for c in ("position", "language", "solution_index")))
    right = solutions.select("task_id", *(F.col(c).alias(f"right_{c}") for c in ("position", "language", "solution_index")))
    pairs = left.join(right, "task_id").filter("left_position < right_position")
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("left_position", "right_position"))
    kind = F.when(F.col("left_language") == F.col("right_language"), "same_task_different_solution").otherwise("cross_language_same_task")
    return pairs.withColumn("__n", rank).filter(F.col("__n") <= most).drop("__n").withColumn("relation_type", kind)


def task_languages(solutions: DataFrame) -> DataFrame:
    """Each task's language, `multi` where its solutions have several."""
    several = F.count_distinct("language") > 1
    return solutions.groupBy("task_id").agg(F.when(several, "multi").otherwise(F.min("language")).alias("language"), F.count("*").alias("solutions"))
