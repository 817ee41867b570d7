"""Global ranks and running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewforge.plans.scratch import materialise


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, rank: str = "rn") -> DataFrame:
    """df with rank, its row number from 1 in the given order, and running sums.

    Rows are range-partitioned by the order and written; each partition counts on its
    own, and the totals of the partitions before it, one small row each, are added.
    order must be total for the result to be determined.
    """
    sums = sums or {}
    keys = {f"__o{k}": column for k, column in enumerate(order)}
    ranged = df.withColumns({f"__s{k}": column.cast("double") for k, column in enumerate(sums.values())})
    ranged = materialise(ranged.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(f"__s{k}").alias(f"__t{k}") for k in range(len(sums))))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = totals.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["__n", *(f"__t{k}" for k in range(len(sums)))]))
    own = Window.partitionBy("__part").orderBy(*order)
    to_here = own.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__part")
    out = out.withColumn(rank, (F.row_number().over(own) + F.col("__n")).cast("long"))
    for k, name in enumerate(sums):
        out = out.withColumn(name, F.sum(f"__s{k}").over(to_here) + F.col(f"__t{k}"))
    return out.drop("__part", "__n", *keys, *(f"__s{k}" for k in range(len(sums))), *(f"__t{k}" for k in range(len(sums))))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation instead of a sorted window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("__first")
    return df.groupBy(*keys).agg(least).select(*keys, *(F.col("__first")[c].alias(c) for c in [*order, *rest])).select(*df.columns)
