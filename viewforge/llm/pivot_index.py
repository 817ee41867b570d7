"""Embedding near-dedup by a pivot-permutation index.

A bounded sample of vectors, no two of them near each other, serves as pivots. Every
vector is described by its nearest pivots in order. It is stored in the inverted list
of its nearest pivot and looked up in the lists of its PROBES nearest. In a list the
LISTED nearest pivots of its vectors are inverted once more: walking a vector's own
pivots counts what others share with it, and only those that share at least SHARED are
verified by cosine in double precision. A list with more rows than a block is split by
hash into blocks that meet pair by pair, so no task holds more than two blocks. A pair
that meets in two lists counts in the one of the lower pivot. Tasks emit counts of links
and a spanning forest of them, never the links, so that dense groups stay linear in size.

Equal vectors are one class until the end, named by a number of its own. Vectors of each
length have their own pivots and lists. Recall rests on the pivots; the README has
measured figures. No pair below the threshold is ever linked.

Defined results: vectors that are null, empty, zero, or that hold null or non-finite
components link with nothing and are their own component; vectors of different lengths
never link; every row counts as a vector of its own, rows that repeat an identifier or
have none too; null identifiers never name a component unless alone in it; an empty table
gives an empty result; further columns, labels too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.components import connected_components
from viewforge.llm.exact_dedup import N_RUNS, group_rows
from viewforge.plans.scratch import materialise, small_side
from viewforge.sources.tables import table

QUERY = "op3_pivot_index"

THRESHOLD = 0.95
#: Pivots: one for so many vectors, within these bounds; chosen from four times as many.
VECTORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 128, 32, 8192
PIVOT_COSINE = 0.5
PROBES, LISTED, SHARED = 6, 12, 3
BLOCK_ROWS = 2048


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, the vector at length 1 as bytes (null if it has none), its 128-bit digest."""
    for batch in batches:
        units: list[bytes | None] = []
        for vector in batch.column(1).to_pylist():
            unit = None
            if vector and None not in vector:
                v = np.asarray(vector, np.float64)
                most = np.abs(v).max()
                if np.isfinite(most) and most > 0:
                    v = v / most
                    unit = (v / np.sqrt(v @ v)).tobytes()
            units.append(unit)
        digests = [u and xxhash.xxh3_128_digest(u) for u in units]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(digests, pa.binary())], names=["id", "unit", "digest"])


def choose_pivots(vectors: DataFrame, wanted: int) -> np.ndarray:
    """Up to wanted pivots from the 4 * wanted vectors of the smallest hash, each far from those before it."""
    sample = vectors.orderBy(F.xxhash64("cls"), "cls").select("unit").limit(4 * wanted).toPandas()
    units = np.stack([np.frombuffer(unit) for unit in sample["unit"]])
    pivots, n = np.empty((wanted, units.shape[1])), 0
    for unit in units:
        if n < wanted and (not n or (pivots[:n] @ unit).max() < PIVOT_COSINE):
            pivots[n] = unit
            n += 1
    return pivots[:n]


def _describe(pivots: dict[int, tuple[int, np.ndarray]], listed: int):
    """pivots has the number of the first pivot and the pivots for each length of a unit's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, part in pdf.groupby(pdf["unit"].map(len)):
                first, own = pivots[length]
                near = np.stack([np.frombuffer(u) for u in part["unit"]]) @ own.T
                yield part.assign(nearest=list((first + np.argsort(-near, axis=1, kind="stable")[:, :listed]).astype(np.int32)))

    return run


def _verify(threshold: float, probes: int, shared: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, one, other = key
        pdf = pdf.sort_values("cls", ignore_index=True)
        units = np.stack([np.frombuffer(u) for u in pdf["unit"]])
        nearest = np.stack(pdf["nearest"].to_numpy())
        names, weights, block = pdf["cls"].to_numpy(), pdf["weight"].to_numpy(), pdf["block"].to_numpy()
        home, probed = nearest[:, 0], nearest[:, :probes]
        owners = home == cell
        first = np.flatnonzero(block == one)
        second = first if one == other else np.flatnonzero(block == other)
        # the inverted lists of second: its rows by pivot
        pivots, where = np.unique(nearest, return_inverse=True)
        where = where.reshape(nearest.shape)
        flat = where[second].ravel()
        order = np.argsort(flat, kind="stable")
        rows = order // nearest.shape[1]
        begins = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
        lists = [rows[a:b] for a, b in zip(begins, begins[1:], strict=False)]
        least, own_second, units_second = min(shared, nearest.shape[1]), owners[second], units[second]
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))

        def tops(k: np.ndarray) -> np.ndarray:
            while True:
                up = root[k]
                if (up == k).all():
                    return k
                k = root[up]

        for i in first.tolist():
            counts = np.bincount(np.concatenate([lists[p] for p in where[i].tolist()]), minlength=len(second))
            near = np.flatnonzero(counts >= least)
            if not owners[i]:
                near = near[own_second[near]]
            if one == other:
                near = near[second[near] > i]
            if not len(near):
                continue
            near = near[units_second[near] @ units[i] >= threshold]
            j = second[near]
            by_j, by_i = (probed[i] == home[j][:, None]).any(1), (probed[j] == home[i]).any(1)
            j = j[np.where(by_i & by_j, np.minimum(home[i], home[j]), np.where(by_j, home[j], home[i])) == cell]
            if len(j):
                links[i] += weights[j].sum()
                links[j] += weights[i]
                heads = tops(np.unique(tops(np.append(j, i))))
                root[heads] = heads.min()
        linked = np.flatnonzero(links)
        return pd.DataFrame({"cls": names[linked], "links": links[linked], "root": names[tops(linked)]}).astype("int64")

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES, listed: int = LISTED, shared: int = SHARED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, n_links, component_id and kept for every row of rows."""
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(N_RUNS)).cast("int")
    units = materialise(chosen.mapInArrow(unit_vectors, "id long, unit binary, digest binary").withColumn("run", dealt), "vectors")
    members = materialise(group_rows(units.filter("unit is not null"), ["digest"], "min"), "vector-members")
    points = members.filter(F.col("id").eqNullSafe(F.col("best"))).groupBy("digest").agg(*(F.any_value(c).alias(c) for c in ("unit", "size", "best")))
    classes = materialise(points.withColumn("cls", F.monotonically_increasing_id()).withColumnRenamed("size", "weight"), "vector-classes")
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    for length, count in classes.groupBy(F.length("unit").alias("n")).count().orderBy("n").collect():  # a row a length
        own = choose_pivots(classes.filter(F.length("unit") == length), min(MOST_PIVOTS, max(LEAST_PIVOTS, count // VECTORS_A_PIVOT)))
        pivots[length] = sum(len(p) for _, p in pivots.values()), own
    described = classes.select("cls", "unit", "weight").mapInPandas(_describe(pivots, listed), "cls long, unit binary, weight long, nearest array<int>")
    entries = materialise(described.withColumn("cell", F.explode(F.slice("nearest", 1, probes))), "vector-lists")
    # one row a pivot
    blocks = entries.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = entries.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cls", "unit", "weight", "nearest", "cell", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other")
    )
    found = materialise(met.groupBy("cell", "one", "other").applyInPandas(_verify(threshold, probes, shared), "cls long, links long, root long"), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), F.col("component").alias("top"))
    linked = classes.select("cls", "digest", "best").join(counts, "cls").join(components, "cls")
    least = linked.groupBy("top").agg(F.min("best").alias("component_id"))
    known = materialise(linked.join(least, "top").select("digest", "links", "component_id"), "vector-components")
    done = members.select("id", "digest", "best", "size").join(small_side(known, 64), "digest", "left")
    done = done.select("id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "best").alias("component_id"))
    rest = units.filter("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
