"""Text functions against Python's own rules."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from viewforge.functions import text as T
from viewforge.operators import prepare as P

TEXTS = [
    "",
    " \t\n",
    "a\r\nb\n\nc",
    "x\vy\fz\x1cq\x85w\u2028e\u2029r",
    "\u00a0a\u3000 b\u2003",
    'quote " back \\ slash \\u001F',
    "c\x01d\x1f\x0b\x00e\x7f",
    "é 日本 𝄞",
    "def f():\n    pass\n\n\n",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, t string")


def column(rows, expression):
    return [r.x for r in rows.select("k", expression.alias("x")).orderBy("k").collect()]


def test_lines_and_tokens(rows):
    t = F.col("t")
    assert column(rows, T.lines(t)) == [x.splitlines() for x in TEXTS]
    assert column(rows, T.line_count(t)) == [sum(1 for line in x.splitlines() if line.strip()) for x in TEXTS]
    assert column(rows, T.token_count(t)) == [len(x.split()) for x in TEXTS]
    assert column(rows, T.strip(t)) == [x.strip() for x in TEXTS]
    assert column(rows, T.closed(t)) == [x.rstrip() + "\n" for x in TEXTS]


def test_hash_is_that_of_json(rows):
    want = [hashlib.sha256(json.dumps([x, 3, "é"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:20] for x in TEXTS]
    assert column(rows, T.stable_hash(F.col("t"), 3, "é")) == want
    assert column(rows, T.stable_hash(F.col("t"), (F.col("k"),), length=8)) == [P.stable_hash(x, k, length=8) for k, x in enumerate(TEXTS)]
    assert column(rows, T.hash_split(F.col("t"))) == [P.split_of(x) for x in TEXTS]


def test_windows_and_comments(rows):
    t = F.col("t")
    assert column(rows, T.line_window(t, F.lit(2), F.lit(2), 1)) == [P.line_window(x, 2, 2, 1) for x in TEXTS]
    for language in ("python", "java"):
        got = column(rows, T.comment_text(t, F.lit(language)))
        assert got[2] == P.comment_text(TEXTS[2], language)


@pytest.mark.parametrize("loc,bucket,weight", [(10, "tiny", 0.35), (11, "short", 1.0), (40, "short", 1.0), (41, "medium", 1.0), (120, "medium", 1.0), (121, "long", 0.6), (250, "long", 0.6), (251, "huge", 0.25)])
def test_buckets(spark, loc, bucket, weight):
    row = spark.range(1).select(T.size_bucket(F.lit(loc)).alias("b"), T.sampling_weight(F.lit(loc)).alias("w"), T.sampling_weight(F.lit(loc), F.lit("local_span_triplet")).alias("l")).first()
    assert (row.b, row.w, row.l) == (bucket, weight, 1.0)
    assert P.bucket_of(loc) == (bucket, weight)
