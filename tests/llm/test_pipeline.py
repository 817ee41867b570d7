from __future__ import annotations

import corpus_pipeline as C
from viewforge.llm import exact_dedup, jaccard_join, repeats
from viewforge.plans.scratch import materialise

TABLES = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, TABLES), f"test-{name}")
        assert docs.columns == columns
        kept.append(docs.count())
        if name == "exact_dedup":
            assert exact_dedup.exact_groups(docs).filter("not kept").count() == 0
        if name == "near_dedup":
            assert jaccard_join.jaccard_components(docs).filter("not id <=> component_id").count() == 0
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4] > 0.8 * kept[0]
    assert repeats.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0] < 0.02 * docs.selectExpr("sum(octet_length(text))").first()[0]
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = C.STAGES[-1][1](spark, docs, TABLES)
    assert packed.select("doc_id").distinct().count() == kept[-1]
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 100


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "q", "en", "s", 1, "y"), (3, "", "en", "s", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for _, stage in C.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)), "odd")
        assert (docs.count() == 0) == empty


def test_namesakes_stay(spark):
    """Only the copy of a text goes, not another text under the same identifier."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a.upper()), (2, b), (3, b + " more"), (None, c), (4, c), (None, "alone")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = materialise(C.drop_exact_copies(spark, df, ""), "t")
    assert sorted((str(r.doc_id), r.text[:3]) for r in left.collect()) == [("2", "A0 "), ("2", "b0 "), ("3", "b0 "), ("4", "c0 "), ("None", "alo")]
    left = C.drop_near_copies(spark, left, "")
    assert sorted((str(r.doc_id), r.text[:3]) for r in left.collect()) == [("2", "A0 "), ("2", "b0 "), ("4", "c0 "), ("None", "alo")]


def test_stages_read_in_small_parts(spark):
    """Scans of a stage hold few rows at a time and no direct buffers; a size that somebody set stays."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows, vectored = "spark.sql.parquet.columnarReaderBatchSize", "parquet.hadoop.vectored.io.enabled"
    try:
        for name in (rows, vectored):
            spark.conf.unset(name)
        C.drop_exact_copies(spark, docs, TABLES)
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        assert hadoop.get(vectored) == "false" and int(hadoop.get(rows)) <= 1024
        spark.conf.set(rows, "77")
        C.drop_exact_copies(spark, docs, TABLES)
        assert spark.conf.get(rows) == "77"
    finally:
        for name in (rows, vectored):
            spark.conf.unset(name)
