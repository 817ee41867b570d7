"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the pre-tokenisation pattern; each match is a word over bytes. A
word is encoded by a tree from its single bytes up: halves are encoded, then
neighbours are joined. A join re-encodes a window around the seam and widens it until
it is stable. Stable means that each pair of adjacent tokens at the window's rims,
encoded alone, gives back the same two tokens. A token sequence of which every adjacent
pair is so is the one encoding of its bytes, so the tokens outside the window cannot
change any more. Split points are powers of two, so that repetitive words leave
remainders only at their ends. Decoding concatenates bytes up a tree over the ids.

Words recur, and so do their parts and seams, so each Python worker keeps bounded tables
of what it has reduced.

Defined results: null text counts as empty; an empty text has no tokens and both
digests are those of the empty string; identifiers are passed through as they are,
repeated or null; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.sources.tables import table

QUERY = "op7_byte_bpe"

#: Entries of each of a worker's tables at most; a full table is begun anew.
KEPT_WORDS = 300_000
#: Bytes of the parts of words that are kept; longer ones recur less.
KEPT_BYTES = 8
#: Symbols of a window up to which a plain list is merged faster than a linked one.
LISTED = 128
#: Tokens whose bytes are put together at a leaf of the decoding tree.
DECODED = 1024


class TreeBpe:
    """Encoder and decoder over a table of ranks: bytes of a token to its id.

    Ids stand for tokens throughout. A pair of ids is one number, and pairs holds the
    id, which is the rank, of every token that is two others joined.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.none = 1 + max(ranks.values())
        self.single = [ranks.get(bytes([k]), self.none) for k in range(256)]
        cuts = ((ranks.get(token[:k]), ranks.get(token[k:]), rank) for token, rank in ranks.items() for k in range(1, len(token)))
        self.pairs = {a * self.none + b: rank for a, b, rank in cuts if a is not None and b is not None}
        tokens = [self.bytes_of.get(k, b"") for k in range(self.none)]
        self._sizes = np.array([len(token) for token in tokens])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._pool = np.frombuffer(b"".join(tokens), np.uint8)
        self._seams: dict[int, list[int] | None] = {}
        self._parts: dict[bytes, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> TreeBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """Merges the leftmost pair of lowest rank until no pair has one; what a window holds is found by this."""
        none, get = self.none, self.pairs.get
        ids = [self.single[b] for b in data]
        if len(ids) > LISTED:
            return self._merged_linked(ids)
        ranks = [get(a * none + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i : i + 2] = [best]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(best * none + ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] * none + best, none)
        return ids

    def _merged_linked(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list, so that a long window costs no square."""
        none, get, n = self.none, self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := get(a * none + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get(rank * none + ids[k])) is not None:
                    heapq.heappush(heap, (new, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (new := get(ids[h] * none + rank)) is not None:
                heapq.heappush(heap, (new, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def seam(self, left: int, right: int) -> list[int] | None:
        """Two neighbours encoded together; None if they are stable, that is, stay what they are."""
        key = left * self.none + right
        found = self._seams.get(key, False)
        if found is False:
            if len(self._seams) >= KEPT_WORDS:
                self._seams.clear()
            ids = self.merged(self.bytes_of[left] + self.bytes_of[right])
            found = self._seams[key] = None if ids == [left, right] else ids
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left followed by those of right."""
        if not left or not right or (window := self.seam(left[-1], right[0])) is None:
            return left + right
        a = b = 1
        while True:
            left_ok = a >= len(left) or self.seam(left[-a - 1], window[0]) is None
            right_ok = b >= len(right) or self.seam(window[-1], right[b]) is None
            if left_ok and right_ok:
                return left[: max(0, len(left) - a)] + window + right[b:]
            a, b = (a if left_ok else 2 * a), (b if right_ok else 2 * b)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-a:] + right[:b])))

    def reduced(self, part: bytes) -> list[int]:
        """The tree over a part of a word: its halves, encoded and joined; a single byte is a leaf."""
        n = len(part)
        if n > KEPT_BYTES:
            half = 1 << ((n - 1).bit_length() - 1)
            return self.join(self.reduced(part[:half]), self.reduced(part[half:]))
        found = self._parts.get(part)
        if found is None:
            if len(self._parts) >= KEPT_WORDS:
                self._parts.clear()
            half = 1 << ((n - 1).bit_length() - 1) if n > 1 else 0
            found = self._parts[part] = self.join(self.reduced(part[:half]), self.reduced(part[half:])) if half else [self.single[part[0]]]
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of a word; one that is itself a token is that token, whatever its merges."""
        if not word:
            return []
        whole = self.ranks.get(word)
        return self.reduced(word) if whole is None else [whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a tree of halves; a leaf copies its tokens out of one pool."""
        if len(ids) > DECODED:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self._pool[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


class TextCoder:
    """Whole texts to ids and back, with bounded tables of words and of chunks.

    A text is first cut before each single space; such a chunk has the same words in it
    as it has in the text, as a space goes with what follows it. Only where a space
    stands between white space is that not so; texts with one are one chunk. A full
    table becomes the old one, from which what is still used goes over into a new one.
    """

    def __init__(self, bpe: TreeBpe, pattern: str):
        self.bpe, self.words = bpe, regex.compile(pattern).findall
        self.inside = re.compile(r"\s \s").search
        self._chunks: dict[str, tuple[bytes, bytes]] = {}
        self._old_chunks: dict[str, tuple[bytes, bytes]] = {}
        self._words: dict[str, tuple[bytes, bytes]] = {}

    def _word(self, word: str) -> tuple[bytes, bytes]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= KEPT_WORDS:
                self._words.clear()
            found = self._words[word] = self._new(word)
        return found

    def _new(self, word: str) -> tuple[bytes, bytes]:
        ids = self.bpe.encode_word(word.encode())
        return b" ".join([b"%d" % i for i in ids]), struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, text: str) -> tuple[bytes, bytes]:
        words = self.words(text)
        if len(words) == 1:
            return self._new(words[0])
        found = list(map(self._word, words))
        return b" ".join([code for code, _ in found]), b"".join([ids for _, ids in found])

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        if len(self._chunks) >= KEPT_WORDS:
            self._chunks, self._old_chunks = {}, self._chunks
        found = self._chunks[chunk] = self._old_chunks.get(chunk) or self._encode(chunk)
        return found

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids as decimal numbers with a space between, and as numbers."""
        if self.inside(text):
            decimal, ids = self._encode(text)
            return decimal, np.frombuffer(ids, "<u4")
        first, *others = text.split(" ")
        get = self._chunks.get
        found = [get(chunk) or self._chunk(chunk) for chunk in [*[first] * bool(first), *[" " + part for part in others]]]
        return b" ".join([code for code, _ in found]), np.frombuffer(b"".join([ids for _, ids in found]), "<u4")


_CODERS: dict[tuple[str, str], TextCoder] = {}


def coder(path: str, pattern: str) -> TextCoder:
    """This process's coder for a rank file and pattern."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TextCoder(TreeBpe.from_file(path), pattern)
    return _CODERS[path, pattern]


def _mapper(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in small(batches):
            counts, ids, id_sums, byte_sums = [], [], [], []
            for text in batch.column(1).to_pylist():
                decimal, found = own.encode(text or "")
                counts.append(len(found))
                id_sums.append(hashlib.sha256(decimal).hexdigest())
                byte_sums.append(hashlib.sha256(own.bpe.decode(found)).hexdigest())
                if with_ids:
                    ids.append(found.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(byte_sums, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every text."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _mapper(path, pattern, with_ids), schema
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of all documents."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
