"""The automaton against greedy longest-match splitting done by hand."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from viewforge.llm import token_counts as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces(word: str, vocabulary: set[str], end: str = K.END) -> int:
    """Greedy longest-match-first; 1 for a word with a symbol that nothing holds."""
    symbols, at, n = [*word, end], 0, 0
    while at < len(symbols):
        for stop in range(len(symbols), at, -1):
            if "".join(symbols[at:stop]) in vocabulary:
                at, n = stop, n + 1
                break
        else:
            return 1
    return n


def test_small_vocabularies():
    rng = random.Random(3)
    for _ in range(300):
        some = {"".join(rng.choices("abc", k=rng.randint(1, 5))) + rng.choice(["", K.END]) for _ in range(rng.randint(1, 12))}
        some |= rng.choice([set(), {"a", "b", "c", "a" + K.END, "b" + K.END, "c" + K.END}])
        automaton = K.LongestMatch(some)
        for _ in range(20):
            word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            assert automaton.count([*word, K.END]) == pieces(word, some)


@pytest.fixture(scope="module")
def counter():
    return K.WordCounter(PATH)


def test_vocabulary(counter):
    import json

    vocabulary = set(json.load(open(PATH, encoding="utf-8"))["model"]["vocab"])
    rng = random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choices("aeiouthnsrlé", k=rng.randint(1, 30)))
        assert counter.count(word)[1] == pieces("".join(counter.symbol[b] for b in word.encode()), vocabulary)


def test_rows(spark, counter):
    rows = spark.createDataFrame([(1, "Hello, hello 12", 5), (2, None, 6), (3, " \n", 7), (1, "Hello, hello 12", 5)], "doc_id long, text string, n_words long")
    out = {r.id: (r.n_words, r.n_tokens) for r in K.count_tokens(rows, PATH).collect()}
    assert out[2] == out[3] == (0, 0) and out[1] == counter.count("Hello, hello 12") and out[1][0] == 5
    assert K.count_tokens(rows.limit(0), PATH).count() == 0
