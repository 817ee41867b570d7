"""Exact dedup by a tree merge of sorted digest runs.

Rows are dealt into runs. A run holds each digest once, sorted, with its row count and
the identifier that would stay. Binomial rounds halve the runs: two neighbours exchange
their rows by range of digests, each range sorted, and one pass merges equal digests of
both, keeping the better identifier and the summed count. A round has half the runs of
the round before and twice the ranges, so all tasks stay busy, and a group of copies of
any size weighs one row a run. The answers go back down the same way: to each run's
digest, then to its rows.

Equality is verified at every level on a second, independent digest and the byte
length beside SHA-256: rows that differ in either stay apart.

Defined results: null text counts as empty; rows with one identifier and one text
are one document, so all of them are kept or dropped alike; null identifiers never
stay unless all of a group are null; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.plans.scratch import materialise
from viewforge.sources.tables import table

QUERY = "op9_exact_dedup"

KEY = ["sha", "mark", "n_bytes"]
#: Runs at the leaves of the tree, a power of two: four rounds whatever the input.
N_RUNS = 16


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        sha, mark, size = [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            text = (text or b"").lower()  # bytes.lower() changes A-Z alone
            sha.append(hashlib.sha256(text).digest())
            mark.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            size.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sha, pa.binary()), pa.array(mark, pa.int64()), pa.array(size, pa.int64())],
            names=["id", "text_mark", *KEY],
        )


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_mark (hash of the text as it is), sha (binary SHA-256), mark (second digest) and n_bytes of every normalised text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_mark"), text.alias("text")).mapInArrow(
        _digest, "id long, text_mark long, sha binary, mark long, n_bytes long"
    )


def _merger(key: list[str], keep: str):
    """Merges rows sorted by slot and key, the rows of a key going on as one with the better best and the sum of size."""
    pick, worst = (np.minimum, 2**63 - 1) if keep == "min" else (np.maximum, -(2**63))
    names = ["slot", *key, "best", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays(both) for both in zip(held.columns, batch.columns, strict=True)], names=names)
            n = batch.num_rows
            new = np.ones(n, bool)
            new[1:] = False
            for name in ("slot", *key):
                column = batch.column(name)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(new)
            best, size = batch.column("best"), batch.column("size").to_numpy()
            named = np.logical_or.reduceat(best.is_valid().to_numpy(zero_copy_only=False), heads)
            best = pick.reduceat(best.fill_null(worst).to_numpy(), heads)
            columns = [batch.column(name).take(pa.array(heads)) for name in ("slot", *key)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(best, mask=~named), pa.array(np.add.reduceat(size, heads))], names=names)
            yield out.slice(0, len(heads) - 1)
            held = out.slice(len(heads) - 1)
        if held is not None:
            yield held

    return run


def merge_runs(runs: DataFrame, key: list[str], n_runs: int, keep: str) -> DataFrame:
    """Binomial rounds over runs (run, key, best, size): neighbours become one sorted run until one is left.

    The first column of key is a binary digest; its leading bits give the range.
    """
    spark = runs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = ", ".join(["slot long", *(f"{name} {kinds[name]}" for name in key), "best long", "size long"])
    ranges = max(0, (4 * tasks // n_runs).bit_length() - 1)
    leading = F.conv(F.hex(F.substring(key[0], 1, 3)), 16, 10).cast("long")
    while n_runs > 1:
        n_runs, ranges = (n_runs + 1) // 2, min(24, ranges + 1)
        slot = F.shiftleft(F.shiftright(F.col("run"), 1).cast("long"), 24) + F.shiftright(leading, 24 - ranges)
        met = runs.select(slot.alias("slot"), *key, "best", "size").repartition("slot").sortWithinPartitions("slot", *key)
        runs = met.mapInArrow(_merger(key, keep), schema).withColumn("run", F.shiftright("slot", 24).cast("int"))
    return runs.select(*key, "best", "size")


def group_rows(rows: DataFrame, key: list[str], keep: str = "min", n_runs: int = N_RUNS) -> DataFrame:
    """rows (a written table of id, key and perhaps run) with best, the group's identifier that stays, and size, its rows."""
    better = {"min": F.min, "max": F.max}[keep]
    if "run" not in rows.columns:
        rows = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(n_runs)).cast("int"))
    runs = rows.groupBy("run", *key).agg(better("id").alias("best"), F.count(F.lit(1)).alias("size"))
    groups = merge_runs(runs, key, n_runs, keep).filter("size > 1")
    down = runs.select("run", *key).join(groups, key)
    return rows.join(down, ["run", *key], "left").withColumns(
        {"best": F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best")), "size": F.coalesce("size", F.lit(1)).cast("long")}
    ).drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", n_runs: int = N_RUNS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 (hex), text_mark.

    keep names which identifier of a group stays, "min" or "max". text_mark is
    xxhash64 of the text as it is, and tells rows of one identifier apart.
    """
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_runs)).cast("int")
    rows = materialise(digest_rows(docs, id_col, text_col).withColumn("run", dealt), "exact-digests")
    return group_rows(rows, KEY, keep, n_runs).select(
        "id",
        F.col("best").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "text_mark",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the largest doc_id of a group stays."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="max").drop("text_mark").withColumnRenamed("id", "doc_id")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
