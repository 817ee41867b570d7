from __future__ import annotations

import hashlib

import duckdb
import pytest

from viewforge.llm import exact_dedup as E

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n_runs", [1, 2, 7, 16])
def test_groups(spark, n_runs):
    rows = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (6, "x"), (6, "x"), (None, "ab É"), (7, "\x00")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, keep_id string")
    out = E.exact_groups(df, keep="max", n_runs=n_runs).collect()
    assert len(out) == len(rows)
    by = {r.id: (r.keep_id, r.group_size, r.kept) for r in out}
    assert by == {1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 2, True), None: (2, 3, False), 7: (7, 1, True)}
    assert {r.id: r.text_sha256 for r in out}[1] == hashlib.sha256("ab É".encode()).hexdigest()
    assert {r.id: r.keep_id for r in E.exact_groups(df, n_runs=n_runs).collect()}[2] == 1


def test_hot_group_and_empty(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) AS text").repartition(8)
    out = E.exact_groups(df, keep="min")
    assert out.filter("kept").count() == 2001 and out.filter("group_size = 1000 and keep_id = 0").count() == 1000
    assert E.exact_groups(df.limit(0)).count() == 0


def test_runs_are_sorted_and_merged(spark, capsys):
    """Each round is a sorted exchange that feeds a merging pass, and a merged run holds each digest once."""
    rows = spark.range(2000).selectExpr("cast(id % 8 as int) AS run", "unhex(sha2(cast(id % 300 as string), 256)) AS sha", "id AS best", "cast(1 as long) AS size")
    merged = E.merge_runs(rows.groupBy("run", "sha").agg({"best": "min", "size": "sum"}).withColumnsRenamed({"min(best)": "best", "sum(size)": "size"}), ["sha"], 8, "min")
    merged.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 3 and plan.count("Sort [slot") == 3
    out = merged.collect()
    assert len(out) == 300 and sum(r["size"] for r in out) == 2000 and {r.best for r in out} == set(range(300))


def test_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id % 1700) AS text").repartition(5)
        out = E.exact_groups(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.keep_id == r.id % 1700 and r.group_size == (3 if r.id % 1700 < 1600 else 2) for r in out) and len(out) == 5000


def test_merger_joins_batches():
    import pyarrow as pa

    def batch(shas, best, size):
        return pa.record_batch([pa.array([0] * len(shas), pa.int64()), pa.array(shas, pa.binary()), pa.array(best, pa.int64()), pa.array(size, pa.int64())], names=["slot", "sha", "best", "size"])

    given = [batch([b"a", b"a", b"b"], [5, None, None], [1, 1, 2]), batch([], [], []), batch([b"b", b"b", b"c"], [None, None, 7], [1, 1, 1]), batch([b"c"], [3], [4])]
    out = pa.Table.from_batches(E._merger(["sha"], "min")(iter(given))).to_pylist()
    assert [(r["sha"], r["best"], r["size"]) for r in out] == [(b"a", 5, 2), (b"b", None, 4), (b"c", 3, 5)]


def test_query(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
    want = duck.execute(E.ORACLE_SQL).df()
    got = E.query(spark, TABLES).toPandas()[list(want.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)
