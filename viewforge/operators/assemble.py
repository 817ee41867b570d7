"""Joins of triples with views, and what they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = ("anchor", "positive", "negative")


def needed_views(triples: DataFrame, views: DataFrame) -> DataFrame:
    """The views that some triple names."""
    ids = triples.select(F.explode(F.array(*(f"{s}_view_id" for s in SIDES))).alias("view_id")).distinct()
    return views.join(ids, "view_id", "left_semi")


def assemble(triples: DataFrame, views: DataFrame) -> DataFrame:
    """triples with the code of each side; those with a missing or empty view go.

    Segments may share views, so views are first made one a view_id.
    """
    code = views.filter(F.coalesce("code", F.lit("")) != "").groupBy("view_id").agg(F.min("code").alias("code"))
    out = triples.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ("positive_transform", "negative_transform") if c in triples.columns})
    for side in SIDES:
        out = out.join(code.select(F.col("view_id").alias(f"{side}_view_id"), F.col("code").alias(side)), f"{side}_view_id")
    return out


def missing_views(triples: DataFrame, views: DataFrame) -> DataFrame:
    """The view identifiers that triples name and views lack, with the number of triples that go for it."""
    ids = triples.select(F.explode(F.array_distinct(F.array(*(f"{s}_view_id" for s in SIDES)))).alias("view_id"))
    have = views.filter(F.coalesce("code", F.lit("")) != "").select("view_id").distinct()
    return ids.groupBy("view_id").agg(F.count("*").alias("triples")).join(have, "view_id", "left_anti")


def pair_codes(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """pairs (left, right, label) with both functions' code (idx, code); pairs of unknown functions go."""
    left = functions.select(F.col("idx").alias("left"), F.col("code").alias("left_code"))
    right = functions.select(F.col("idx").alias("right"), F.col("code").alias("right_code"))
    return pairs.join(left, "left").join(right, "right")


def labelled_pairs(triples: DataFrame) -> DataFrame:
    """Each triple as a pair of label 1 and a pair of label 0."""
    pairs = F.array(F.struct(F.col("positive").alias("right"), F.lit(1).alias("label")), F.struct(F.col("negative").alias("right"), F.lit(0).alias("label")))
    return triples.select("triple_id", F.col("anchor").alias("left"), F.explode(pairs).alias("p")).select("triple_id", "left", "p.right", "p.label")


def union_all(*tables: DataFrame) -> DataFrame:
    """The rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def union_segments(*segments: DataFrame, key: str) -> DataFrame:
    """The rows of all segments, one for each key."""
    return union_all(*segments).dropDuplicates([key])


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """Each value of column with a dense identifier from 0 in order of name."""
    from viewforge.operators.ranking import running

    names = rows.select(F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias("name")).distinct()
    return running(names, [F.col("name")], rank="id").withColumn("id", F.col("id") - 1)


def interned_pairs(pairs: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Functions (idx, code) and pairs (left, right, label) of rows with left_code, right_code and label.

    A function's number is its place among the first occurrences, left before right.
    """
    from viewforge.operators.files import intern_texts

    sides = pairs.select((F.col(order) * 2).alias("at"), F.col("left_code").alias("code")).unionByName(pairs.select((F.col(order) * 2 + 1).alias("at"), F.col("right_code").alias("code")))
    numbered, of = intern_texts(sides, "code", "at")
    functions = numbered.join(sides.select(F.col("at").alias("first_row"), "code"), "first_row").select("idx", "code")
    left, right = (of.filter(F.pmod("at", F.lit(2)) == k).select(F.floor(F.col("at") / 2).alias(order), F.col("idx").alias(name)) for k, name in ((0, "left"), (1, "right")))
    return functions, pairs.select(order, "label").join(left, order).join(right, order).select(order, "left", "right", "label")
