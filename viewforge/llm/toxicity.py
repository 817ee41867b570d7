"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin,
digits and signs that stand for letters to those letters, everything between words to
spaces. The lexicon holds words and beginnings of words. Its weights are log odds
over the labelled training rows, counted by document; a longer entry that says no
more than a shorter one it begins with is left out, so that one entry speaks for a
whole word family. Matches inside an exception phrase don't count. A text's weights
are summed, one match a word, and taken in proportion to its length; a logistic
curve over sum, proportion and largest weight turns them into a probability. It is
fitted on training rows that the lexicon wasn't counted on.

At most TRAINING_ROWS labelled rows are learnt from, those of the smallest hash; this
bound is a parameter. Everything that leaves the executors for the driver is bounded:
LEXICON_ENTRIES entries, and three numbers for each of the rows that fit the curve.

Defined results: null or empty text has no match and gets the lowest score of its
curve; a document with several labels counts once for each; labels other than 0 and 1
are ignored; without training labels of both kinds the score is that of the built-in
lexicon; repeated rows score alike; null identifiers are scored, never learnt from;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import give_back, small
from viewforge.plans.scratch import materialise
from viewforge.sources.tables import table

QUERY = "op6_toxicity"

TRAINING_ROWS = 100_000
LEXICON_ENTRIES = 20_000
PREFIX_LETTERS = range(3, 11)
LEAST_TOXIC = 3
LEAST_ODDS = 1.5
THRESHOLD = 0.7

#: Look-alike letters and the Latin letters they pass for.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝкмтвнαονρτυχκιε", "aeopcyxijsdhqwkmtbhaovptuxkie", strict=True))
#: Digits and signs read as letters.
SUBSTITUTES = dict(zip("013457@$", "oieastas", strict=True))
#: Entries that hold without any label, and harmless phrases around them.
BUILT_IN = {" idiot": 4.0, " moron": 4.0, " stupid": 4.0, " scum": 4.0, " worthless": 4.0, " pathetic": 4.0, " disgusting": 4.0, " loser ": 4.0, " losers ": 4.0, " trash ": 3.0, " clown ": 3.0}
EXCEPTIONS = (" trash can ", " trash bin ", " trash bag ", " clown fish ", " class clown ", " pond scum ", " loser pays ", " disgusting smell ", " stupid mistake ", " pathetic fallacy ")

_FOLD = {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()} | {c: " " for c in [*range(33), *b"!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~", 0x85, 0xA0, 0xA1, 0xAB, 0xBB, 0xBF, 0x2028, 0x2029, 0x3000, *range(0x2000, 0x2020)]}
_FOLD |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def fold(text: str) -> str:
    """The text as it is matched: folded words between spaces, with a space at either end."""
    return f" {text.lower().translate(_FOLD)} "


def entries_of(words: set[str]) -> set[str]:
    """The whole words and beginnings of words that may become entries."""
    found = {f" {w} " for w in words if len(w) > 2}
    for n in PREFIX_LETTERS:
        found.update(f" {w[:n]}" for w in words if len(w) > n)
    return found


def odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of an entry, lowered by its own uncertainty."""
    a, b = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    return np.log(a) - np.log(b) - 1.0 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicon_of(weights: dict[str, float], toxic: dict[str, int]) -> dict[str, float]:
    """weights without the entries that others make needless.

    An entry goes if a longer one that begins with it has nine tenths of its documents,
    the longer one being as telling and more exact; and if a shorter entry that it
    begins with weighs nearly as much.
    """
    vague = {e[:n] for e in weights for n in range(3, len(e)) if e[:n] in weights and 10 * toxic[e] >= 9 * toxic[e[:n]]}
    kept: dict[str, float] = {}
    for entry in sorted(weights.keys() - vague, key=lambda e: (len(e), e)):
        shorter = [kept[entry[:n]] for n in range(3, len(entry)) if entry[:n] in kept]
        if not shorter or weights[entry] > max(shorter) + 0.7:
            kept[entry] = weights[entry]
    return kept


class Matcher:
    """Counts of a folded text against a lexicon and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), -1.0))
        self.automaton.make_automaton()

    def measures(self, text: str) -> tuple[float, float, float]:
        """Sum of weights, one match a word; that per root of the words; largest weight."""
        folded = fold(text)
        at: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(folded):
            start = end - n + 1
            if weight < 0:
                exempt.append((start, end))
            elif weight > at.get(start, 0.0):
                at[start] = weight
        for a, b in exempt:
            for start in [s for s in at if a <= s < b]:
                del at[start]
        total = sum(at.values())
        return total, total / math.sqrt(10 + folded.count(" ")), max(at.values(), default=0.0)


def curve_features(m: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of the measures (sum, proportion, largest)."""
    return np.column_stack([np.log1p(m[:, 0]), np.minimum(m[:, 1], 5.0), m[:, 2], np.ones(len(m))])


def fit_curve(m: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton steps."""
    f, beta = curve_features(m), np.zeros(4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        gain = f.T @ (y - p) - ridge * beta
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + ridge * np.eye(4), gain)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _count_mapper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries by the number of toxic and clean documents, added up in each partition."""
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}

    def flush() -> pd.DataFrame:
        # entries that this partition has seen in clean documents only matter where another has them in toxic ones
        names = list(toxic.keys() | clean.keys())
        out = pd.DataFrame({"entry": names, "toxic": [toxic.get(e, 0) for e in names], "clean": [clean.get(e, 0) for e in names]})
        toxic.clear()
        clean.clear()
        return out

    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            counts = toxic if y else clean
            for entry in entries_of(set(fold(text or "").split())):
                counts[entry] = counts.get(entry, 0) + 1
            if len(toxic) + len(clean) > 200_000:
                yield flush()
    if toxic or clean:
        yield flush()
    give_back()


class Scorer:
    """A lexicon with its curve."""

    def __init__(self, lexicon: dict[str, float], beta: np.ndarray):
        self.lexicon, self.beta = lexicon, beta
        self._matcher: Matcher | None = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "beta": self.beta, "_matcher": None}

    def measures(self, texts: list[str | None]) -> np.ndarray:
        if self._matcher is None:
            self._matcher = Matcher(self.lexicon)
        return np.array([self._matcher.measures(t or "") for t in texts], float).reshape(-1, 3)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve_features(self.measures(texts)) @ self.beta, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train, training_rows: int = TRAINING_ROWS, lexicon_entries: int = LEXICON_ENTRIES) -> Scorer:
    """A scorer from the labelled rows that the condition train (on doc_id) allows.

    docs has doc_id and text, labels doc_id and toxic.
    """
    built_in = Scorer(BUILT_IN, np.array([0.0, 1.0, 1.0, -3.0]))
    known = labels.filter(train & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    n = known.count()
    # at most about training_rows rows of 24 bytes are broadcast
    if n > training_rows:  # hashes are even, so the share below this bound is the share wanted
        known = known.filter(F.col("h") < F.lit(int(-(2**63) + 2**64 * (training_rows / n))))
    learnt = materialise(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", F.pmod("h", F.lit(4)).alias("part")), "toxicity-training")
    counting, fitting = learnt.filter("part > 0"), learnt.filter("part = 0")
    sizes = {int(r.y): r.n for r in counting.groupBy("y").agg(F.count("*").alias("n")).toLocalIterator()}
    if len(sizes) < 2:
        return built_in
    n_toxic, n_clean = sizes[1], sizes[0]
    counts = counting.select("text", "y").mapInPandas(_count_mapper, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counts.filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * n_clean > 3 * F.col("clean") * n_toxic)).orderBy(F.desc(F.col("toxic") - F.col("clean") * (n_toxic / n_clean)), "entry").limit(lexicon_entries).toPandas()
    weights = dict(zip(found["entry"], odds(found["toxic"].to_numpy(float), found["clean"].to_numpy(float), n_toxic, n_clean).tolist(), strict=True))
    lexicon = lexicon_of({e: w for e, w in weights.items() if w >= LEAST_ODDS}, dict(zip(found["entry"], found["toxic"].tolist(), strict=True)))
    scorer = Scorer({e: w for e, w in BUILT_IN.items() if e not in weights} | lexicon, built_in.beta)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = scorer.measures(pdf["text"].tolist())
            yield pd.DataFrame({"a": m[:, 0], "b": m[:, 1], "c": m[:, 2], "y": pdf["y"].to_numpy(float)})

    fitted = fitting.select("text", "y").mapInPandas(measure, "a double, b double, c double, y double").toPandas()
    if 0 < fitted["y"].sum() < len(fitted):
        scorer.beta = fit_curve(fitted[["a", "b", "c"]].to_numpy(), fitted["y"].to_numpy())
    return scorer


def _score_mapper(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    return run


def toxicity_scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_score_mapper(scorer), "id long, score double")


def clean_rows(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    """Whether a row's labels are kept from learning: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = toxicity_scores(docs, fit(docs, labels, ~held_out() & F.col("doc_id").isNotNull()))
    return scores.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
