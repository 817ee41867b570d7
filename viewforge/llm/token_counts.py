"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A node that spells a token fails to the root and pops one
token; any other node fails to where its parent's failure path can take its symbol,
and pops what that path popped. A word is then read symbol by symbol with a fixed
amortised cost: no child means adding the node's popped count and following its
link. The sum is the number of pieces of greedy longest-match-first splitting; no
piece is ever built. Symbols are the byte characters of the vocabulary file, and one
more for the end of a word.

Words recur, so each Python worker keeps a bounded table from word to its count.

Defined results: null text counts as empty; an empty text has zero words and tokens;
a word with a symbol that no token holds is one unknown token; identifiers are
passed through, repeated or null; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.sources.tables import table

QUERY = "op10_token_counts"

END = "</w>"
#: How the vocabulary's own tokenizer splits lower-case text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_WORDS = 500_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class LongestMatch:
    """Trie of the tokens with failure links and popped counts."""

    def __init__(self, tokens):
        self.children: list[dict[str, int]] = [{}]
        spells = [False]
        for token in tokens:
            ends = token.endswith(END)
            node = 0
            for symbol in [*(token[: -len(END)] if ends else token), *[END] * ends]:
                child = self.children[node].get(symbol)
                if child is None:
                    child = self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    spells.append(False)
                node = child
            spells[node] = node > 0
        self.fail = [-1] * len(spells)
        self.popped = [0] * len(spells)
        level = [(0, symbol, child) for symbol, child in self.children[0].items()]
        while level:
            deeper = []
            for parent, symbol, node in level:
                if spells[node]:
                    self.fail[node], self.popped[node] = 0, 1
                else:
                    self.fail[node], self.popped[node] = self._follow(self.fail[parent], symbol, self.popped[parent])
                deeper += [(node, s, child) for s, child in self.children[node].items()]
            level = deeper

    def _follow(self, node: int, symbol: str, popped: int) -> tuple[int, int]:
        while node >= 0:
            child = self.children[node].get(symbol)
            if child is not None:
                return child, popped
            popped += self.popped[node]
            node = self.fail[node]
        return -1, 0

    def count(self, symbols: list[str]) -> int:
        """Pieces of one word; 1 if some symbol cannot be matched."""
        node = total = 0
        for symbol in symbols:
            node, total = self._follow(node, symbol, total)
            if node < 0:
                return 1
        while node > 0:
            total += self.popped[node]
            node = self.fail[node]
        return total if node == 0 else 1


class WordCounter:
    """Counts of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.automaton = LongestMatch(json.load(file)["model"]["vocab"])
        self.split, self.symbol = regex.compile(WORDS).findall, byte_characters()
        self._kept: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = self.split(unicodedata.normalize("NFC", text).lower())
        if len(self._kept) > KEPT_WORDS:
            self._kept.clear()
        found = list(map(self._kept.get, words))
        if None in found:
            for word in {w for w, n in zip(words, found, strict=True) if n is None}:
                self._kept[word] = self.automaton.count([*(self.symbol[b] for b in word.encode()), END])
            found = list(map(self._kept.get, words))
        return len(words), sum(found)


_COUNTERS: dict[str, WordCounter] = {}


def _mapper(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = WordCounter(path)
        for batch in small(batches):
            counts = [_COUNTERS[path].count(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w for w, _ in counts], pa.int64()), pa.array([n for _, n in counts], pa.int64())],
                names=["id", "n_words", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of every text, with the vocabulary file at path."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _mapper(path), "id long, n_words long, n_tokens long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")
