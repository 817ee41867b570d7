"""Tree encoding against the tiktoken library, and round trips."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from viewforge.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text: str) -> list[int]:
    coder = byte_bpe.coder(PATH, public_tokenizers.PATTERN)
    decimal, found = coder.encode(text)
    assert coder.bpe.decode(found) == text.encode()
    assert [int(i) for i in decimal.split()] == found.tolist()
    return found.tolist()


HARD = ["", "a", "a" * 1000, "abc" * 777, "ab" * 5000, " " * 300, "\n \n" * 50, "é" * 500, "日本語" * 100, "=-" * 333, "x\x1cy\x85z", "<|endoftext|>", "0123456789" * 40, "a\n \nb", " a  b   c \n d", "\n  x", "a \t b ", " ", "  ", "\n ", "it's 's  'll"]


@pytest.mark.parametrize("text", HARD)
def test_hard(theirs, text):
    assert ids(text) == theirs.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.text(alphabet="ab  .,'é\n\t1", max_size=400))
def test_any(theirs, a, b):
    for text in (a, b):
        assert ids(text) == theirs.encode_ordinary(text)


def test_join_is_the_whole():
    bpe = byte_bpe.TreeBpe.from_file(PATH)
    word = b"antidisestablishmentarianism" * 9
    whole = bpe.merged(word)
    assert bpe.decode(np.array(whole)) == word
    for k in range(1, len(word), 17):
        assert bpe.join(bpe.encode_word(word[:k]), bpe.encode_word(word[k:])) == whole


def test_ordinary_words_are_joined_up_the_tree(monkeypatch):
    """Words that are no token themselves come from joins of halves, some of which widen their window."""
    bpe = byte_bpe.TreeBpe.from_file(PATH)
    joins, windows = [], []
    join, merged = bpe.join, bpe.merged
    monkeypatch.setattr(bpe, "join", lambda a, b: joins.append(1) or join(a, b))
    monkeypatch.setattr(bpe, "merged", lambda data: windows.append(len(data)) or merged(data))
    for word in (b" erthblely", b" thndathe", b" anreed", b" unbelievablyness"):
        assert bpe.encode_word(word) == merged(word)
    assert len(joins) >= 30 and len(windows) > 10


def test_rows(spark, theirs):
    rows = spark.createDataFrame([(1, "ab cd", "x"), (1, "ab cd", "x"), (2, None, None), (None, "", "y")], "doc_id long, text string, n_tokens string")
    out = byte_bpe.encode_texts(rows, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == 4
    by = {r.id: r for r in out}
    assert by[1].ids == theirs.encode_ordinary("ab cd") and by[1].n_tokens == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert (by[2].n_tokens, by[2].ids_sha256, by[2].decoded_sha256) == (0, empty, empty) and by[None].ids == []
    assert byte_bpe.encode_texts(rows.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
