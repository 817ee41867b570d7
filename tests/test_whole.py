"""Queries that do the whole job, where a short cut would give other results."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from viewforge.operators import metrics, tokens
from viewforge.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


def test_first_relevant_ranks_have_no_limit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    # each label twice, but for 140 rows of one and a row of none; two rows are the same
    labels = [0] * 140 + [1, 1, 2, 2, 3, 3, 4, None, None, 5]
    x[20] = x[10]
    ids = [int(i) for i in rng.permutation(150)]
    rows = spark.createDataFrame([(i, y, [float(v) for v in e]) for i, y, e in zip(ids, labels, x)], "id long, label long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    want = {}
    for a in range(150):
        others = sorted((b for b in range(150) if b != a), key=lambda b: (-scores[a, b], ids[b]))
        if found := [n for n, b in enumerate(others, 1) if labels[b] is not None and labels[b] == labels[a]]:
            want[ids[a]] = found[0]
    assert max(want.values()) > 50 and len(want) == 146
    for block_rows in (1024, 40):
        assert {r["query"]: r["rank"] for r in metrics.first_relevant_ranks(rows, block_rows).collect()} == want


def test_retrieval_metrics_of_all_queries(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    want = duck.execute(ORACLES["retrieval_metrics"].replace(" AND rank <= 50", "")).df()
    got = QUERIES["retrieval_metrics"](spark, TABLES).toPandas()[list(want.columns)]
    assert got["queries"][0] == 500 and got.astype(str).equals(want.astype(str))


def _oracle_map_at_r(folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return duck.execute(ORACLES["map_at_r"]).fetchone()


def test_map_at_r_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = [[float(v) for v in e] for e in rng.normal(size=(90, 3))]
    labels = [int(v) for v in rng.integers(0, 3, 90)]
    # copies in two labels, a row of no direction, one of no vector, rows of no label and one alone in its label
    x[20] = x[21] = x[22] = x[10]
    x[30], x[31], x[32] = [0.0] * 3, None, None
    labels[40] = labels[41] = labels[31] = None
    labels[50] = 7
    ids = [int(i) * 1_000_000_007 - 10**10 for i in rng.permutation(90)]
    rows = spark.createDataFrame(list(zip(ids, labels, x, strict=True)), "vec_id long, label int, embedding array<double>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = _oracle_map_at_r(tmp_path)
    assert want[1] == 86 and tuple(QUERIES["map_at_r"](spark, str(tmp_path)).first()) == want
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    for sizes in ((1024, 8, 1 << 20), (7, 16, 1 << 20), (16, 5, 3000)):
        got = metrics.map_at_r(vectors, *sizes).first()
        assert (round(got["map_at_r"], 6), got["queries"]) == want


def test_map_at_r_exchanges_no_pairs(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(1500, 4))
    rows = spark.createDataFrame([(i, i % 2, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, label int, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().executorList(False)))

    before = written()
    got = tuple(QUERIES["map_at_r"](spark, str(tmp_path)).first())
    # each query has 749 rows before its depth; all of them would be many megabytes
    assert written() - before < 1 << 20
    assert got == _oracle_map_at_r(tmp_path)


def test_map_at_r_writes_floats_as_floats(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(7).normal(size=(300, 64))
    rows = spark.createDataFrame([(i, i % 3, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, label int, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    made, write = {}, metrics.materialise
    monkeypatch.setattr(metrics, "materialise", lambda df, tag: made.setdefault(tag, write(df, tag)))
    got = tuple(QUERIES["map_at_r"](spark, str(tmp_path)).first())
    assert made["coded-vectors"].schema["embedding"].dataType.simpleString() == "array<float>"
    assert sum(len(r[-1]) for r in made["vector-blocks"].collect()) == 300 * 64 * 4
    assert got == _oracle_map_at_r(tmp_path)


def test_all_bytes_are_tokens_and_masked(spark):
    texts = spark.createDataFrame([(1, "é" * 300), (2, ""), (3, "abc")], "id long, s string")
    got = {r["id"]: r["t"] for r in texts.select("id", tokens.byte_ids(F.encode("s", "UTF-8")).alias("t")).collect()}
    assert got == {1: [b + 1 for b in "é".encode()] * 300, 2: [], 3: [98, 99, 100]}
    # about 15 % of all bytes, not of the first few
    sizes = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", F.octet_length("text").alias("n")).collect()}
    masked = {r["source_row_index"]: r["masked"] for r in QUERIES["masked_byte_tokens"](spark, TABLES).collect()}
    assert 0.14 < sum(masked.values()) / sum(n or 0 for n in sizes.values()) < 0.16


def test_byte_tokens_at_the_length_of_the_reference(spark):
    rows = QUERIES["byte_tokens_padded_256"](spark, TABLES).collect()
    assert {len(r["tokens"].split(" ")) for r in rows} == {256} and max(r["n"] for r in rows) == 256


def test_rejects_at_the_limit_of_the_operator(spark, tmp_path):
    text = "word word word word word word\\n" * 1000
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    reasons = {name: [r["reason"] for r in QUERIES[name](spark, str(tmp_path)).collect()] for name in ("row_filters_rejects", "row_filters_rejects_200k")}
    assert reasons == {"row_filters_rejects": ["skipped_too_large"], "row_filters_rejects_200k": ["skipped_loc"]}


def test_windows_of_the_reference_cover_680_lines(spark, tmp_path):
    text = "".join(f"line {k}\n" for k in range(1, 701))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    last = {name: max(r["end_line"] for r in QUERIES[name](spark, str(tmp_path)).collect()) for name in ("file_windows", "file_windows_120")}
    assert last == {"file_windows": 90, "file_windows_120": 680}
