"""Quality scores by random Fourier features over document statistics.

One pass over the texts turns each into a short vector of statistics: shares of
character classes, word and line shapes, repetition. Features cos(W x + b) with
Gaussian W approximate a Gaussian kernel over the standardised vectors. Ridge scores
come from the normal equations, which every partition sums on its own over its
training rows; the sums are added in a tree and solved once. Isotonic regression of
labels on the ridge scores, fitted by pooling neighbours over a fixed number of score
bins, turns scores into probabilities. It is fitted on a fold of the training rows, one
in FOLDS, that the ridge has not seen; where that fold or the rest is empty, both see
all rows.

All labelled training rows take part: what reaches the driver is one matrix of fixed
size and one table of bins, at any size of the input.

Defined results: null or empty text has the statistics of an empty text and is scored
like any other; a document with several labels counts once for each; labels other
than 0 and 1 or of unknown documents are ignored; without any training label each
score is 0.5; repeated rows are scored alike; null identifiers are scored and never
trained on; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.plans.scratch import materialise
from viewforge.sources.tables import table

QUERY = "op8_quality"

FOLDS = 5

WIDTH = 192
#: The kernel's length scale in standard deviations.
SCALE = 3.0
RIDGE = 1e-3
BINS = 512
SEED = 20_240_801
THRESHOLD = 0.7

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": b" \t",
    "line": b"\n\r",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|<>[]{}\\/_=~^`",
    "symbol": b"#$%&*+@",
    "quote": b"\"'()-",
    "high": range(128, 256),
}
STATISTICS = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "distinct_words", "same_next", "distinct_lines", "line_words", "longest_word", "title_words", "top_word"]
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _OF_CLASS[list(_members), _k] = 1


def statistics(text: bytes) -> list[float]:
    """The vector of one text, in the order of STATISTICS."""
    n = max(1, len(text))
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _OF_CLASS / n).tolist()
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *shares,
        math.log1p(len(text)),
        math.log1p(len(words)),
        min(40.0, n / m),
        math.log((len(counts) + 1) / (len(words) + 1)),
        same / m,
        len(set(lines)) / len(lines),
        math.log1p(m / len(lines)),
        math.log1p(max(map(len, words), default=0)),
        sum(map(bytes.istitle, words)) / m,
        max(counts.values(), default=0) / m,
    ]


def _statistics_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = [statistics(text or b"") for text in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the statistics of every text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _statistics_mapper, "id long, x array<double>"
    )


class FourierRidge:
    """Random Fourier features with a ridge on top and calibrated by a step function."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: int, scale: float, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = random.normal(size=(len(mean), width)) / scale
        self.b = random.uniform(0, 2 * np.pi, width)
        self.beta = np.zeros(width + len(mean) + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), z / 8, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least weighted squares, by pooling neighbours."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            u = pools[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + n
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def tree_sum(parts: DataFrame, size: int, fan_in: int = 16) -> np.ndarray:
    """The sum of vectors v of one length, added up fan_in at a time before any reaches the driver."""
    parts = parts.withColumn("k", F.spark_partition_id() % 4096)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for v in pdf["v"]:
            total += np.asarray(v)
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "v": [total]})

    width = 4096
    while width > fan_in:
        width //= fan_in
        parts = parts.withColumn("k", F.col("k") % width).groupBy("k").applyInPandas(add, "k long, v array<double>")
    total = np.zeros(size)
    for row in parts.toLocalIterator():
        total += np.asarray(row.v)
    return total


def fit(train: DataFrame, width: int = WIDTH, scale: float = SCALE, ridge: float = RIDGE, seed: int = SEED) -> FourierRidge:
    """A model of y (0 or 1) on x from all rows of train; those of fold 0 calibrate it."""
    d = len(STATISTICS)
    folds = {bool(r.seen) for r in train.groupBy((F.col("fold") > 0).alias("seen")).count().collect()}
    train, calibrating = (train.filter("fold > 0"), train.filter("fold = 0")) if len(folds) > 1 else (train, train)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * d + 1)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                total += np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]])
        yield pd.DataFrame({"v": [total]})

    total = tree_sum(train.mapInPandas(moments, "v array<double>"), 2 * d + 1)
    n = total[-1]
    if not n:
        return FourierRidge(np.zeros(d), np.ones(d), width, scale, seed)
    mean = total[:d] / n
    model = FourierRidge(mean, np.sqrt(np.maximum(0, total[d : 2 * d] / n - mean**2)), width, scale, seed)
    p = len(model.beta)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((p, p)), np.zeros(p)
        for pdf in batches:
            if len(pdf):
                f, y = model.features(np.stack(pdf["x"].to_numpy())), pdf["y"].to_numpy(float)
                a += f.T @ f
                b += f.T @ y
        yield pd.DataFrame({"v": [np.concatenate([a.ravel(), b])]})

    total = tree_sum(train.mapInPandas(equations, "v array<double>"), p * p + p)
    gram, right = total[: p * p].reshape(p, p), total[p * p :]
    model.beta = np.linalg.solve(gram + ridge * n / p * np.eye(p), right)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = np.zeros((2, BINS))
        for pdf in batches:
            if len(pdf):
                at = np.clip(((model.raw(np.stack(pdf["x"].to_numpy())) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                table_[0] += np.bincount(at, minlength=BINS)
                table_[1] += np.bincount(at, weights=pdf["y"].to_numpy(float), minlength=BINS)
        yield pd.DataFrame({"v": [table_.ravel()]})

    counts, ones = tree_sum(calibrating.mapInPandas(binned, "v array<double>"), 2 * BINS).reshape(2, BINS)
    full = counts > 0
    centres = (np.flatnonzero(full) + 0.5) / BINS * 2 - 0.5
    base = ones.sum() / counts.sum()
    model.steps = centres, isotonic((ones[full] + base) / (counts[full] + 1), counts[full])
    return model


def _score_mapper(model: FourierRidge):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.score(np.stack(pdf["x"].to_numpy())) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"id": pdf["id"], "score": np.clip(score, 0, 1)})

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, train: object, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row of docs.

    labels has doc_id and quality; train is a condition on `id` that names the rows
    whose labels may be learnt from.
    """
    rows = materialise(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y"))
    learnt = materialise(rows.filter(train).join(known.filter(train), "id").select("x", "y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold")), "quality-training")
    model = fit(learnt)
    return rows.mapInPandas(_score_mapper(model), "id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; rows whose crc32(doc_id) mod 4 is 2 are held out."""
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select(
        F.col("id").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
