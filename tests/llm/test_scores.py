"""Toxicity and quality: held-out accuracy, and cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewforge.llm import quality, toxicity

TABLES = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module,label,mod,rest,least", [(toxicity, "toxic", 3, 1, 0.97), (quality, "quality", 4, 2, 0.98)])
def test_held_out(spark, module, label, mod, rest, least):
    got = module.query(spark, TABLES).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").toPandas()
    held = got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % mod == rest)
    assert (held == got["held_out"]).all() and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    own = got[held]
    assert (own["predicted"] == own[label]).mean() >= least


def rows(spark):
    data = [(1, "you idiot"), (2, None), (3, ""), (4, "fine words here"), (4, "fine words here"), (None, "an 1d1ot")]
    return spark.createDataFrame([(*r, 1.0) for r in data], "doc_id long, text string, score double")


def test_toxicity_cases(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = rows(spark)
    scorer = toxicity.fit(df, none, F.lit(True))
    out = toxicity.toxicity_scores(df, scorer).collect()
    by = {r.id: r.score for r in out}
    assert len(out) == 6 and by[1] > 0.7 and by[None] > 0.7 and by[2] == by[3] < 0.1 and by[4] < 0.1
    kept = toxicity.clean_rows(df, scorer)
    assert kept.columns == df.columns and kept.count() == 4
    assert toxicity.toxicity_scores(df.limit(0), scorer).count() == 0


def test_empty_partitions(spark):
    docs = spark.createDataFrame([(k, "you idiot fool" if k % 2 else "fine words here") for k in range(40)], "doc_id long, text string").repartition(30)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic", "1 AS quality").filter("doc_id < 30")
    out = {r.id: r.score for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert min(out[k] for k in range(1, 40, 2)) > max(out[k] for k in range(0, 40, 2))
    assert quality.quality_scores(docs, labels, F.lit(True)).count() == 40


def test_folding_and_exceptions():
    matcher = toxicity.Matcher(toxicity.BUILT_IN)
    for text in ("IDIOT", "1d1ot", "іdіоt", "you,idiot!", "id​iot"):
        assert matcher.measures(text)[0] > 0
    assert matcher.measures("put it in the trash can")[0] == 0 < matcher.measures("this trash")[0]
    assert matcher.measures("idiot")[1] > matcher.measures("idiot " + "word " * 500)[1]


def test_lexicon_prefers_exact_and_general():
    weights = {" lowei": 5.0, " low": 5.1, " loweia": 5.2, " abc": 3.0, " abcd ": 3.1}
    counts = {" lowei": 100, " low": 104, " loweia": 9, " abc": 50, " abcd ": 49}
    assert set(toxicity.lexicon_of(weights, counts)) == {" lowei", " abcd "}


def test_quality_cases(spark):
    df = rows(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality_scores(df, none, F.lit(True)).collect()
    assert len(out) == 6 and {r.score for r in out} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (9, 1), (2, 7)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(df, some, F.lit(True)).collect())
    assert quality.quality_scores(df.limit(0), some, F.lit(True)).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    values, weights = rng.random(50), rng.random(50) + 0.1
    fitted = quality.isotonic(values, weights)
    assert (np.diff(fitted) >= 0).all() and abs((fitted - values) @ weights) < 1e-9
    assert quality.isotonic(np.array([1.0, 2.0, 3.0]), np.ones(3)).tolist() == [1, 2, 3]


def test_sums_are_whole(spark):
    parts = spark.range(50).repartition(40).selectExpr("array(cast(id as double), 1d) AS v")
    assert quality.tree_sum(parts, 2, fan_in=4).tolist() == [49 * 25, 50]
