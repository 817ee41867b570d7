"""Best-fit packing by hierarchical residual rounds.

Every text becomes token ids and one closing id; only what exceeds the capacity is
cut. Pieces are dealt evenly into groups of bounded size. Each group packs its
pieces by best fit, largest first. After it a group has at most one bin that is no more
than half full. Underfull bins go up a tree as items: those up to half full, and as many
of the emptiest others, come together in bounded groups, and best fit runs over whole
bins, until one group is left or the two emptiest bins don't fit together. Nothing is
lost by leaving the fuller bins out: two bins that fit together have one of at most half
among them, each of these takes at most one of the others, and what doesn't fit into the
emptiest bin left over fits into no fuller one. So at the root no two sequences fit
together. A bin's place in its parent is kept as one small row, so a piece's sequence
and offset are found by following at most one row a level.

Groups are dealt by row, not by identifier, so repeated and null ones spread evenly.

Defined results: null text counts as empty; an empty text is one piece with the
closing id alone; repeated rows are packed once each (their doc_id and piece repeat);
null identifiers are packed like any other; ties in length go by identifier, then
piece; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.llm.token_counts import WORDS, byte_characters
from viewforge.plans.scratch import materialise
from viewforge.sources.tables import table

QUERY = "op1_best_fit_packing"

CAPACITY = 4096
#: Items that one task packs at most.
GROUP_ITEMS = 50_000
KEPT_WORDS = 250_000
LEVEL_BITS, GROUP_BITS = 56, 28


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    White space never joins a token and normalisation never crosses it, so a text's
    ids are those of its chunks between white space, kept in a bounded table. The
    separators U+001C to U+001F are white space for str.split() alone; texts that
    hold them are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.symbols, self.split = self.tokenizer.model.tokenize, byte_characters(), regex.compile(WORDS).findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self._kept: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """The ids of one lower-case word, straight from the merges."""
        ids = self._kept.get(piece)
        if ids is None:
            found = [t.id for t in self.merges(piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode())))]
            ids = self._kept[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _add(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks into the table.

        Letters below U+0250 are composed as they are and lower-cased one by one, so such
        chunks are split into words here; others go through the whole tokenizer.
        """
        others = []
        for chunk in chunks:
            if (chunk.isascii() or max(chunk) < "\u0250" and "\u0130" not in chunk) and "<|" not in chunk:
                low = chunk.lower()
                self._kept[chunk] = self._piece(low) if low.isalpha() else b"".join(map(self._piece, self.split(low)))
            else:
                others.append(chunk)
        self._kept.update(zip(others, self._encode(others), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new chunks are encoded in one call."""
        if len(self._kept) > KEPT_WORDS:
            self._kept.clear()
        chunks = [None if self.odd(text) else text.split() for text in texts]
        self._add(set().union(*filter(None, chunks)).difference(self._kept))
        kept = self._kept.__getitem__
        return [self._encode([text])[0] if own is None else b"".join(map(kept, own)) for text, own in zip(texts, chunks, strict=True)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def _piecer(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in small(batches):
            rows: list[tuple] = []
            docs, texts = (column.to_pylist() for column in batch.columns)
            for doc, ids in zip(docs, _ENCODERS[path].ids([text or "" for text in texts]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            doc, piece, start, length, crc, part = zip(*rows, strict=True) if rows else [()] * 6
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(part, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of every piece."""
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _piecer(path, end_id, capacity, with_ids), schema
    )


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, items taken in the order given, and the fill of each bin.

    An item goes where the least room is left over. A bit for each room that some bin
    has finds that bin in one step.
    """
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0
    for k, size in enumerate(sizes.tolist()):
        fitting = has >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                has ^= 1 << free
        else:
            at, free = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = at, fills[at]
        fills[at] += size
        if free > size:
            room[free - size].append(at)
            has |= 1 << (free - size)
    return bins, offsets, fills


def _group_packer(level: int, capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets, fills = best_fit(items["length"].to_numpy(), capacity)
        base = (level << LEVEL_BITS) | (int(items["grp"].iloc[0]) << GROUP_BITS)
        return items.assign(bin=base + bins, offset=offsets, fill=np.asarray(fills, np.int64)[bins])

    return run


def _pack_level(items: DataFrame, level: int, capacity: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", bin long, offset long, fill long"
    return materialise(items.groupBy("grp").applyInPandas(_group_packer(level, capacity), schema).drop("grp"), f"packing-{level}")


def _dealt(rows: DataFrame, n: int, group_items: int) -> tuple[DataFrame, int]:
    """rows with grp, their group of about group_items, by row; and the number of groups."""
    groups = max(1, math.ceil(n / group_items))
    return rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), groups


def _underfull(bins: DataFrame, capacity: int) -> DataFrame | None:
    """Bins (bin, fill) that may still come together, or None if no two can."""
    counts = sorted(bins.groupBy("fill").count().toPandas().itertuples(index=False))  # a row a fill
    fills = [fill for fill, count in counts for _ in range(min(count, 2))][:2]
    if len(fills) < 2 or sum(fills) > capacity:
        return None
    small = sum(count for fill, count in counts if 2 * fill <= capacity)
    left, last = small, capacity // 2
    for fill, count in counts:
        if 2 * fill > capacity and fill + fills[0] <= capacity and left > 0:
            left, last = left - count, fill
    chosen = bins.filter(F.col("fill") <= last if left >= 0 else F.col("fill") < last)
    if left < 0:  # of the last fill no more than are needed
        of_last = next(count for fill, count in counts if fill == last)
        chosen = chosen.unionByName(bins.filter(F.col("fill") == last).limit(of_last + left))
    return chosen


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """pieces (id, piece, length and any further columns) with sequence_id and offset."""
    pieces = materialise(pieces, "packing-pieces")
    dealt, groups = _dealt(pieces, pieces.count(), group_items)
    packed = _pack_level(dealt, 0, capacity).withColumnRenamed("bin", "sequence_id")
    bins = packed.filter("offset = 0").select(F.col("sequence_id").alias("bin"), "fill")  # a row a bin
    result, level, steps = packed.drop("fill"), 0, []
    while groups > 1:
        level += 1
        bins = materialise(bins, f"packing-bins-{level}")
        if (chosen := _underfull(bins, capacity)) is None:
            break
        chosen = materialise(chosen, f"packing-open-{level}")
        items, groups = _dealt(chosen.select(F.col("bin").alias("id"), F.lit(0).alias("piece"), F.col("fill").alias("length")), chosen.count(), group_items)
        merged = _pack_level(items, level, capacity)
        steps.append(merged.select(F.col("id").alias("sequence_id"), F.col("bin").alias("parent"), F.col("offset").alias("shift")))
        bins = merged.filter("offset = 0").select("bin", "fill")
    for step in steps:
        result = result.join(step, "sequence_id", "left").select(
            *[c for c in result.columns if c not in ("sequence_id", "offset")],
            F.coalesce("parent", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = pack(token_pieces(table(spark, sf_dir, "documents"), path))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
