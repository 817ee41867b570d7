"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.plans.scratch import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b).

    Each round orders the nodes anew by a hash and lets every node point to the first
    of itself and its neighbours; edges then join what their ends point to. Loops and
    repeats go, so the edges shrink by a constant factor a round whatever the shape of
    the graph. Minima are taken by partial aggregation, and edges of a hub meet their
    hub in a join whose large partitions Spark splits. Nothing is collected.

    Edges with a null end, loops and repeated edges are ignored; nodes of no other edge
    are left out; no edges give no rows.
    """
    left = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(steps))

        def ordered(c: str, salt=salt):
            return F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("v"))

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.least(F.min(ordered("b")), F.min(ordered("a"))).alias("m"))
        step = materialise(first.select(F.col("a").alias("node"), F.col("m.v").alias("to")), "cc-step")
        moved = step.filter("node <> to")
        for end in ("a", "b"):
            left = left.join(moved, left[end] == moved["node"], "left").select(F.coalesce("to", end).alias(end), "b" if end == "a" else "a")
        left = materialise(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(done: DataFrame, step: DataFrame) -> DataFrame:
        moved = step.filter("node <> to").select(F.col("node").alias("root"), F.col("to").alias("next"))
        return done.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    roots = materialise(reduce(follow, steps[1:], steps[0].select("node", F.col("to").alias("root"))), "cc-roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
