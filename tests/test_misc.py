from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from viewforge.functions import text as T
from viewforge.functions import vectors as V
from viewforge.operators import files, metrics, profile, ranking, sampling, tokens
from viewforge.sources import mixed
from viewforge.streaming import run_log


def test_running_is_global(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 37) % 101 AS k").repartition(7)
    out = ranking.running(rows, [F.col("k"), F.desc("id")], {"total": F.col("id")}).orderBy("rn").collect()
    want = sorted(((r * 37) % 101, -r) for r in range(1000))
    assert [(r.k, -r.id) for r in out] == want and [r.rn for r in out] == list(range(1, 1001))
    total = 0
    for r in out:
        total += r.id
        assert r.total == total
    assert ranking.running(rows.limit(0), [F.col("k")]).count() == 0


def test_mixed_scan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"a": 3, "b": "x"}]))
    spark.createDataFrame([(4, 1.5)], "a long, c double").write.parquet(str(tmp_path / "c"))
    rows = mixed.mixed_scan(spark, str(tmp_path))
    assert sorted(r.a for r in rows.collect()) == [1, 2, 3, 4] and set(rows.columns) == {"a", "b", "c"}
    assert mixed.first_existing(spark, str(tmp_path / "no"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        mixed.first_existing(spark, str(tmp_path / "no"))


def test_run_log(spark, tmp_path):
    log = [{"event": "startup"}] + [{"event": "train", "step": k, "seq_len": 128 + 64 * (k % 2), "examples_per_s": float(k), "tokens_per_s": 1.0, "batch_s": 0.5} for k in range(6)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, log)))
    rows = mixed.run_log(spark, str(tmp_path / "m.jsonl")).withColumn("run", F.lit("r"))
    out = {r.seq_len: (r.logs, r.median_examples_per_s, r.median_step_s, r.median_loader_s) for r in profile.seq_len_summary(rows, "run", ["step"]).collect()}
    assert out == {128: (2, 3.0, 0.5, 0.0), 192: (3, 3.0, 0.5, 0.0)}
    assert profile.steady(rows.limit(1), "run", ["step"]).count() == 1
    assert profile.markdown(spark.createDataFrame([(2, None), (1, 0.5)], "k int, v double"), "k") == "| k | v |\n| - | - |\n| 1 | 0.5 |\n| 2 |  |\n"


def test_eta(spark):
    counts = spark.createDataFrame([(128, 3600), (256, 7200)], "bucket int, n long")
    rates = spark.createDataFrame([(128, 1.0)], "bucket int, rate double")
    assert profile.weighted_eta(counts, rates).first().missing_buckets == 1
    both = profile.weighted_eta(counts, spark.createDataFrame([(128, 1.0), (256, 2.0)], "bucket int, rate double")).first()
    assert (both.hours, both.examples_per_s) == (2.0, 1.5)
    assert spark.range(1).select(profile.eta_hours(F.lit(3600), F.lit(0.0))).first()[0] is None


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("a", "2024-01-02 09:00:00", 9.0)], "event_type string, t string, value double")
    rows = rows.select("event_type", F.to_timestamp("t").alias("ts"), "value")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    for _ in range(2):
        query = run_log.follow(spark, source, "event_type string, ts timestamp, value double", sink, str(tmp_path / "state"))
        query.awaitTermination(120)
    assert [(r.logs, r.mean_rate) for r in spark.read.parquet(sink).collect()] == [(2, 2.0)]


def test_token_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2, 3], [4], [5]), (2, list(range(200)), [4], [5])], "k int, anchor_ids array<int>, positive_ids array<int>, negative_ids array<int>")
    cache = tokens.bucketed(rows, (4, 128))
    tokens.write_cache(cache, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c")).orderBy("k").collect()
    assert [(r.bucket_len, r.truncated, len(r.anchor_ids), len(r.negative_ids)) for r in back] == [(4, False, 4, 4), (128, True, 128, 128)]
    tokens.check_cache(cache, 200, 128)
    with pytest.raises(ValueError):
        tokens.check_cache(cache, 100, 128)


def test_samples(spark):
    rows = spark.range(500).selectExpr("id", "id % 5 AS shard", "if(id < 400, 128, 256) AS bucket_len")
    one, again = (sampling.sample(rows, "id", 50, 3).select("id").collect() for _ in range(2))
    assert one == again and len({r.id for r in one}) == 50
    assert sampling.sample(rows, "id", 9999, 3).count() == 500
    out = sampling.epoch_batches(rows, "id", "shard", 32, 1, 0).collect()
    assert len(out) == 480 and all(sum(r.batch == b for r in out) == 32 for b in range(15))
    buckets = sampling.bucket_batches(rows, "id", "bucket_len", {128: 64, 256: 128}, 1, 0)
    assert buckets.count() == 384
    with pytest.raises(ValueError):
        sampling.label_triplets(spark.createDataFrame([(1, "a"), (2, "a")], "id long, label string"), 0)


def test_masks(spark):
    rows = spark.range(300).select("id", F.array(*(F.lit(k) for k in range(1, 21))).alias("t"))
    out = rows.select("t", sampling.mask_tokens(F.col("t"), F.col("id"), 100, 999).alias("m")).collect()
    targets = [x for r in out for x in r.m if x.target >= 0]
    assert all(any(x.target >= 0 for x in r.m) for r in out)
    assert 0.12 < len(targets) / 6000 < 0.2 and 0.7 < sum(x.token == 999 for x in targets) / len(targets) < 0.9
    assert all(x.token == t for r in out for x, t in zip(r.m, r.t, strict=True) if x.target < 0)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0], [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "a array<double>, b array<double>, s array<array<double>>, m array<double>")
    out = row.select(V.l2_normalise(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.masked_mean(F.col("s"), F.col("m")).alias("p"), V.pair_features(F.col("a"), F.col("b")).alias("f")).first()
    assert (out.n, out.c, out.p, out.f) == ([0.6, 0.8], 0.8, [2.0, 4.0], [3.0, 4.0, 0.0, 2.0, 3.0, 2.0, 0.0, 8.0])


def test_degenerate_metrics(spark):
    same = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.5)], "id long, label int, score double")
    assert metrics.roc_auc(same).first().roc_auc == 0 and metrics.average_precision(same).first().average_precision == 0
    tied = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (3, 1, 0.1)], "id long, label int, score double")
    best = metrics.best_f1(tied).first()
    assert (round(best.f1, 6), best.threshold) == (0.8, 0.1)
    single = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "id long, label string, embedding array<double>")
    assert metrics.map_at_r(single).first().map_at_r == 0
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 1, 0.8), (2, 2, 0.7)], "query long, id long, score double")
    assert metrics.in_batch_accuracy(scores).first().accuracy == 0.5


def test_retrieval_rows_need_enough(spark):
    rows = spark.createDataFrame([(1, "one two three", "a b c d e f g h")], "k int, q string, c string")
    assert files.retrieval_rows(rows, "q", "c", "k", 10).count() == 1
    with pytest.raises(ValueError, match="fewer than 10"):
        files.retrieval_rows(rows, "q", "c", "k", 10, least_rows=10)


def test_json_values(spark):
    given = ['{"a": 1, "solutions": [2], "b": {"c": 3}}', "[1]", "{", None, '{"a": "x"}', "7"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, j string")
    out = {r.k: (r.s, r.p) for r in df.select("k", T.scrub_metadata(F.col("j")).alias("s"), T.parse_json_maybe(F.col("j")).alias("p")).collect()}
    assert [out[k][0] for k in range(6)] == ['{"a":"1","b":"{\\"c\\":3}"}', "{}", "{}", "{}", '{"a":"x"}', "{}"]
    assert [out[k][1] for k in range(6)] == ['{"a":1,"b":{"c":3},"solutions":[2]}', "[1]", None, None, '{"a":"x"}', "7"]


def test_token_spans_positions():
    from viewforge.code import languages as L

    code = "é a\n\nbb(ü, cc)\n d"
    spans = L.token_spans("u", code, 3)
    assert [(s["start_line"], s["start_col"], s["end_line"], s["end_col"], s["start_byte"], s["end_byte"], s["source"]) for s in spans] == [(1, 2, 1, 3, 3, 4, "a"), (3, 0, 3, 2, 6, 8, "bb"), (3, 6, 3, 8, 13, 15, "cc")]
    assert len(L.token_spans("u", "x " * 50_000, 10**6)) == 50_000
