"""Removal of repeated passages by enhanced suffix arrays over shared anchors.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
document of smaller identifier, or earlier in the same one.

1. Every window of LENGTH bytes has an anchor, the gram of least hash in it; equal
   windows have equal anchors at equal places. Windows that follow each other mostly
   share one, so a document is a chain of spans with one anchor each. Windows of one
   span never repeat inside it, as their anchors have different places.
2. Equal spans are one class, a symbol of the suffix arrays: its first occurrence
   brings the bytes, the others are its list. Copies are folded in each task before
   anything is exchanged, so that a class of any size weighs about one row a task.
3. Classes that occur again, or whose anchor has other classes, are compared where
   they share a core: bytes that all windows have whose anchor's place lies in a
   range. Each core's group gets an enhanced suffix array; a stack scan over its
   common-prefix lengths yields the intervals of at least LENGTH, single leaves with
   a list among them, whose left neighbours differ: the maximal repeats, each with all
   of its occurrences. All but the first are marked, one merged interval a run.
4. A group of more than GROUP_SPANS spans is split before it meets in a task: its range
   of places is halved, so that cores grow, and equal parts are folded by content. A
   range of one place has one window a core, so this ends after seven halvings.
5. A document's marks are checked against its bytes, joined and cut out.

Class hashes only propose: a mark carries a digest of the bytes that the suffix array
compared, and nothing goes whose own bytes don't have it.

Defined results: null text counts as empty; shorter texts lose nothing; rows that
repeat an identifier and text are one document and lose the same bytes; of different
texts under one identifier each loses what it repeats itself, equal bytes at one place
being one occurrence; rows with a null identifier are compared with nothing and keep
all; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.plans.scratch import discard, materialise, small_side
from viewforge.sources.tables import table

QUERY = "op5_repeated_passages"

LENGTH = 100
GRAM = 24
#: Grams in a window; the first part of the places an anchor can have, for the right core.
PLACES = LENGTH - GRAM + 1
RIGHT_PLACES = PLACES // 2
CHUNK_BYTES = 2 << 20
#: Spans that one task compares at most; larger groups are split.
GROUP_SPANS = 2_000
#: Classes whose copies a task folds over all of its texts; others fold within a chunk.
KEPT_CLASSES = 100_000
#: In the low byte of a packed place: the class occurs again; this is another occurrence.
MANY, AGAIN = 128, 255

SPAN = "key long, places int, doc long, start long, shift int, text binary, cls long"
MARK = "cls long, shift int, doc long, start long, part long"

_M = 0x9E3779B97F4A7C15
_BYTE_HASH = np.random.default_rng(20_240_801).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the odd multiplier and of its inverse, modulo 2**64."""
    if not _POWERS:
        for m in (_M, pow(_M, -1, 1 << 64)):
            factors = np.full(CHUNK_BYTES + 4 * LENGTH, m, np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(hashed: np.ndarray) -> np.ndarray:
    """The hash of each run of GRAM bytes, put together from runs of powers of two."""
    parts, width, run = [], 1, hashed
    rest = GRAM
    while rest:
        if rest & 1:
            parts.append((width, run))
        rest >>= 1
        if rest:
            run = run[:-width] * np.uint64(pow(_M, width, 1 << 64)) + run[width:]
            width *= 2
    n = len(hashed) - GRAM + 1
    total, at = np.zeros(n, np.uint64), 0
    for width, run in parts:
        total = total * np.uint64(pow(_M, width, 1 << 64)) + run[at : at + n]
        at += width
    return _mix(total)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width keys."""
    run, have = keys, 1
    while 2 * have <= width:
        run = np.minimum(run[:-have], run[have:])
        have *= 2
    return np.minimum(run[: len(keys) - width + 1], run[width - have :]) if have < width else run


def spans_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts laid end to end: anchor hash, class hash, start, length, place of the anchor.

    ends are the texts' ends; windows across an end don't count.
    """
    hashed = _BYTE_HASH[data]
    grams = _gram_hashes(hashed)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_least(keys, PLACES) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(0, ends - begins - LENGTH + 1)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    windows = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    own = anchors[windows]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1))
    first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(windows) - 1)
    start, stop, anchor = windows[first], windows[last] + LENGTH, own[first]
    powers, inverse = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * powers[: len(hashed)], dtype=np.uint64)])
    whole = (sums[stop] - sums[start]) * inverse[start]
    size, place = stop - start, anchor - start
    shape = size.astype(np.uint64) * np.uint64(1 << 20) + place.astype(np.uint64)
    return grams[anchor], _mix(whole + _mix(shape * np.uint64(_M))), start, size, place


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Identifiers, offsets and bytes of texts and slices of long texts, about CHUNK_BYTES together."""
    docs: list[int] = []
    offsets: list[int] = []
    parts: list[bytes] = []
    size = 0
    for batch in small(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if doc is None or text is None or len(text) < LENGTH:
                continue
            for at in range(0, len(text) - LENGTH + 1, CHUNK_BYTES // 2):
                part = text[at : at + CHUNK_BYTES // 2 + LENGTH - 1]
                docs.append(doc)
                offsets.append(at)
                parts.append(part)
                size += len(part)
                if size >= CHUNK_BYTES // 2:
                    yield docs, offsets, parts
                    docs, offsets, parts, size = [], [], [], 0
    if parts:
        yield docs, offsets, parts


def _spans_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows val, cls, doc, at: at packs start, length over LENGTH and the anchor's place with MANY, or AGAIN."""
    kept = np.zeros((3, 0), np.int64)  # class, doc and start of first occurrences known to have copies
    for docs, offsets, parts in _chunks(batches):
        ends = np.cumsum([len(p) for p in parts])
        val, cls, start, size, place = spans_of(np.frombuffer(b"".join(parts), np.uint8), ends)
        text = np.searchsorted(ends, start, side="right")
        doc = np.array(docs, np.int64)[text]
        start = start - np.concatenate([[0], ends[:-1]])[text] + np.array(offsets, np.int64)[text]
        order = np.lexsort((start, doc, cls, val))
        val, cls, doc, start, size, place = (x[order] for x in (val, cls.view(np.int64), doc, start, size, place))
        new = np.concatenate([[True], (val[1:] != val[:-1]) | (cls[1:] != cls[:-1])])[: len(val)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(val)), 0))
        again = (doc != doc[head]) | (start != start[head])
        many = np.zeros(len(val), bool)
        many[head[again]] = True
        if kept.shape[1]:
            at = np.minimum(np.searchsorted(kept[0], cls), kept.shape[1] - 1)
            again |= (kept[0, at] == cls) & ((doc > kept[1, at]) | (doc == kept[1, at]) & (start > kept[2, at]))
        if kept.shape[1] < KEPT_CLASSES and (fresh := many & ~again).any():
            _, first = np.unique(both := np.concatenate([kept[0], cls[fresh]]), return_index=True)
            kept = np.stack([both, np.concatenate([kept[1], doc[fresh]]), np.concatenate([kept[2], start[fresh]])])[:, first]
        # what repeats is spread by document, away from its anchor
        val = np.where(again, _mix(doc.astype(np.uint64) * np.uint64(_M) + start.astype(np.uint64)), val)
        packed = (start << 16) | ((size - LENGTH) << 8) | np.where(again, AGAIN, place | many * MANY)
        yield pa.RecordBatch.from_arrays([pa.array(val.view(np.int64)), pa.array(cls), pa.array(doc), pa.array(packed)], names=["val", "cls", "doc", "at"])


def _classes_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by val, cls, doc, at: other occurrences, with AGAIN; first ones of classes that occur again or share an anchor."""
    held: list[np.ndarray] | None = None  # the class that may go on in the next batch
    shared = False  # whether that class's anchor had another one before it

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cls", "doc", "at"])

    for batch in batches:
        val, cls, doc, at = (c.to_numpy() for c in batch.columns)
        known = (at & 255) == AGAIN
        if known.any():
            yield emit([cls[known], doc[known], at[known]])
            val, cls, doc, at = (x[~known] for x in (val, cls, doc, at))
        if not len(val):
            continue
        if held is not None:
            val, cls, doc, at = (np.concatenate(x) for x in zip(held, (val, cls, doc, at), strict=True))
        new_val = np.concatenate([[True], val[1:] != val[:-1]])
        new = new_val | np.concatenate([[True], cls[1:] != cls[:-1]])
        heads = np.flatnonzero(new)
        head = heads[np.cumsum(new) - 1]
        again = (doc != doc[head]) | (at >> 16 != at[head] >> 16)
        many = np.logical_or.reduceat(again | ((at & MANY) > 0), heads)
        begins = new_val[heads]
        contested = ~begins
        contested[0] |= shared
        shared = bool(contested[-1])
        contested[:-1] |= ~begins[1:]
        firsts = at[heads] | many * MANY
        out = heads[:-1][(contested | many)[:-1]]
        yield emit([np.concatenate([cls[again], cls[out]]), np.concatenate([doc[again], doc[out]]), np.concatenate([at[again] | AGAIN, firsts[:-1][(contested | many)[:-1]]])])
        k = heads[-1]
        held = [val[k : k + 1], cls[k : k + 1], doc[k : k + 1], firsts[-1:]]
    if held is not None and (shared or held[3][0] & MANY):
        yield emit(held[1:])


def core_key(text: bytes, far: int, low: int, high: int) -> int:
    """Key of the bytes that all windows share whose anchor's place lies from low to high; far is its place in text."""
    return xxhash.xxh3_64_intdigest(text[far - low : far - high + LENGTH], low << 8 | high) - (1 << 63)


def _part(text: bytes, far: int, low: int, high: int) -> tuple[int, bytes] | None:
    """Where text's windows with the anchor at places from low to high begin, and their bytes."""
    most, least = min(far, high), max(far - len(text) + LENGTH, low)
    return (far - most, text[far - most : far - least + LENGTH]) if least <= most else None


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch of rows in the order of a schema string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _cores_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each first span the parts whose windows hold the right or the left core."""
    halves = ((0, RIGHT_PLACES - 1), (RIGHT_PLACES, PLACES - 1))
    for batch in small(batches):
        out = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for span in spans:
                at = span["at"]
                begin, far = at >> 16, at & 127
                whole = (text or b"")[begin : begin + (at >> 8 & 255) + LENGTH]
                if len(whole) < (at >> 8 & 255) + LENGTH:
                    continue  # a shorter text under the same identifier
                for low, high in halves:
                    if part := _part(whole, far, low, high):
                        shift, piece = part
                        out.append((core_key(whole, far, low, high), low << 16 | high << 8 | far - shift, doc, begin + shift, shift, piece, span["cls"] if at & MANY else None))
        yield _rows(out, SPAN)


def packed_part(text: bytes) -> int:
    """Length and digest of bytes in one number."""
    return (xxhash.xxh3_64_intdigest(text) & ~255 | len(text)) - (1 << 63)


def _marks(row: tuple) -> list[tuple]:
    """Marks over all of a span's part, for the span itself and for its class."""
    _, _, doc, start, shift, text, cls = row
    part = packed_part(text)
    return [(None, None, doc, start, part)] + [(cls, shift, None, None, part)] * (cls is not None)


def _split_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of large groups by halves of their places; equal parts in one task are folded to the first and marks."""
    first: dict[int, tuple[bytes, int, int]] = {}
    for batch in small(batches):
        out, marks = [], []
        for _, places, doc, start, shift, text, cls in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high, far = places >> 16, places >> 8 & 255, places & 255
            middle = (low + high) // 2
            for low, high in ((low, middle), (middle + 1, high)):
                if low <= high and (part := _part(text, far, low, high)):
                    more, piece = part
                    row = (core_key(text, far, low, high), low << 16 | high << 8 | far - more, doc, start + more, shift + more, piece, cls)
                    known = first.get(row[0])
                    if known and known[0] == piece and (doc, start + more) > known[1:]:
                        marks += _marks(row)
                    else:
                        out.append(row)
                        if not known and len(first) < KEPT_CLASSES:
                            first[row[0]] = (piece, doc, start + more)
        yield _tagged(out, marks)


def _tagged(rows: list[tuple], marks: list[tuple]) -> pa.RecordBatch:
    """Spans, and marks as spans without text whose key is their part."""
    return _rows(rows + [(part, None, doc, start, shift, None, cls) for cls, shift, doc, start, part in marks], SPAN)


def _fold_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, text, doc, start: of equal parts the first, and marks for the others; marks as they are."""
    last: tuple | None = None
    for batch in small(batches):
        out, marks = [], []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[5] is None:
                out.append(row)
            elif last is None or (row[0], row[5]) != (last[0], last[5]):
                out.append(row)
                last = row
            elif row[2:4] != last[2:4]:
                marks += _marks(row)
        yield _tagged(out, marks)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def maximal_repeats(texts: list[bytes], least: int = LENGTH, many: list[bool] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Length and all occurrences (text, place) of each maximal repeat of at least `least` bytes.

    The suffix array holds the suffixes long enough to matter. Intervals of common
    prefixes are opened and closed on a stack; each knows whether its occurrences have
    different bytes before them, the start of a text being different from all. A text
    that many names stands for several, so its leaf is a maximal repeat by itself.
    """
    for k, text in enumerate(texts):
        if many and many[k] and len(text) >= least:
            yield len(text), [(k, 0)]
    suffixes = sorted((text[j:], k, j) for k, text in enumerate(texts) for j in range(len(text) - least + 1))
    if not suffixes:
        return
    lengths = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
        lengths.append(common_prefix(a, b) if a[:least] == b[:least] else 0)
    lengths.append(0)
    before = [texts[k][j - 1] if j else -1 - i for i, (_, k, j) in enumerate(suffixes)]
    stack: list[list] = []  # length, first suffix, the one byte before all so far or None
    for i in range(1, len(suffixes) + 1):
        first, left = i - 1, before[i - 1]
        while stack and stack[-1][0] > lengths[i]:
            length, first, seen = stack.pop()
            seen = seen if seen == left else None
            if seen is None:
                yield length, [(k, j) for _, k, j in suffixes[first:i]]
            left = seen
        if lengths[i] >= least:
            if stack and stack[-1][0] == lengths[i]:
                if stack[-1][2] != left:
                    stack[-1][2] = None
            else:
                stack.append([lengths[i], first, left])


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs (start, stop) that parts (start, length) cover."""
    runs: list[tuple[int, int]] = []
    for start, length in sorted(parts):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], start + length))
        else:
            runs.append((start, start + length))
    return runs


def group_marks(group: list[tuple]) -> Iterator[tuple]:
    """Marks of a group of spans: the runs of each, and of its class's other occurrences, that start earlier elsewhere."""
    texts, many = [row[5] for row in group], [row[6] is not None for row in group]
    own: list[list[tuple[int, int]]] = [[] for _ in group]
    others: list[list[tuple[int, int]]] = [[] for _ in group]
    # windows of one span differ, so a single one has its leaf alone
    found = maximal_repeats(texts, LENGTH, many) if len(group) > 1 else [(len(texts[0]), [(0, 0)])] * many[0]
    for length, places in found:
        first = min((group[k][2], group[k][3] + j) for k, j in places)
        for k, j in places:
            if (group[k][2], group[k][3] + j) != first:
                own[k].append((j, length))
            if many[k]:
                others[k].append((j, length))
    for (_, _, doc, start, shift, text, cls), mine, theirs in zip(group, own, others, strict=True):
        for a, b in merged(mine):
            yield None, None, doc, start + a, packed_part(text[a:b])
        for a, b in merged(theirs):
            yield cls, shift + a, None, None, packed_part(text[a:b])


def _repeats_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the marks of each group."""
    group: list[tuple] = []
    out: list[tuple] = []
    for batch in small(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                if len(group) > 1 or group[0][6] is not None:
                    out += group_marks(group)
                group.clear()
                if len(out) > 20_000:
                    yield _rows(out, MARK)
                    out.clear()
            group.append(row)
    if group:
        out += group_marks(group)
    yield _rows(out, MARK)


def cut(text: bytes, marks: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of text without marked parts that it really holds, the bytes removed, the runs removed."""
    parts = []
    for mark in marks or ():
        start, part = mark["start"], mark["part"]
        held = text[start : start + (part + (1 << 63) & 255)]
        if packed_part(held) == part:
            parts.append((start, len(held)))
    left, at, runs = [], 0, merged(parts)
    for start, stop in runs:
        left.append(text[at:start])
        at = stop
    left.append(text[at:])
    return b"".join(left), sum(b - a for a, b in runs), len(runs)


def _cut_mapper(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, marks in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                left, removed, runs = cut(text, marks)
                rows.append((len(text), removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:-1], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(arrays) - (not with_text)])

    return run


def _group_found(cores: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Marks of the groups of cores, a written table; and of groups too large for a task the spans, split and folded, if any."""
    counts = cores.groupBy("key").count().filter(F.col("count") > GROUP_SPANS).select(F.col("key").alias("large"))
    large = materialise(counts, "repeats-large")
    none = large.isEmpty()
    keys = None if none else small_side(large, 16)
    fit = cores if none else cores.join(keys, cores["key"] == keys["large"], "left_anti")
    grouped = fit.repartition("key").sortWithinPartitions("key", "doc", "start")
    found = materialise(grouped.mapInArrow(_repeats_mapper, MARK), "repeats-found")
    if none:
        return found, None
    halves = cores.join(keys, cores["key"] == keys["large"], "left_semi").mapInArrow(_split_mapper, SPAN)
    dealt = F.when(F.col("text").isNull(), F.xxhash64("doc", "start", "cls")).otherwise(F.xxhash64("key", "text"))
    folded = halves.repartition(dealt).sortWithinPartitions("key", "text", "doc", "start").mapInArrow(_fold_mapper, SPAN)
    return found, materialise(folded, "repeats-split")


def repeat_marks(texts: DataFrame) -> DataFrame:
    """doc, start and part (length and digest) of repeated parts of texts (id, text); they overlap."""
    spans = texts.mapInArrow(_spans_mapper, "val long, cls long, doc long, at long")
    sorted_spans = spans.repartition("val").sortWithinPartitions("val", "cls", "doc", "at")
    seen = materialise(sorted_spans.mapInArrow(_classes_mapper, "cls long, doc long, at long"), "repeats-classes")
    later = seen.filter(f"at & 255 = {AGAIN}").select("cls", "doc", F.shiftright("at", 16).alias("at"))
    firsts = seen.filter(f"at & 255 <> {AGAIN}").groupBy("doc").agg(F.collect_list(F.struct("at", "cls")).alias("spans"))
    held = texts.join(firsts, texts["id"] == firsts["doc"]).select("id", "text", "spans")
    cores: DataFrame | None = materialise(held.mapInArrow(_cores_mapper, SPAN), "repeats-cores")
    tables: list[DataFrame] = []
    while cores is not None:
        found, rest = _group_found(cores)
        if not tables:
            discard(cores)
        tables.append(found)
        if rest is not None:
            tables.append(rest.filter("text is null").select("cls", "shift", "doc", "start", F.col("key").alias("part")))
            rest = rest.filter("text is not null")
        cores = rest
    found = reduce(DataFrame.unionByName, tables)
    own = found.filter("cls is null").select("doc", "start", "part")
    of_class = found.filter("cls is not null").select("cls", "shift", "part")
    return own.unionByName(later.join(of_class, "cls").select("doc", (F.col("at") + F.col("shift")).alias("start"), "part"))


def _by_document(texts: DataFrame) -> DataFrame:
    return repeat_marks(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "part")).alias("marks"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text of every row of docs.

    kept_text is what is left, read as UTF-8 without characters that were cut apart.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = _by_document(texts)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(marks, texts["id"] == marks["doc"], "left").select("id", "text", "marks").mapInArrow(_cut_mapper(with_text), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with what is left of each text, and its characters in chars_col if there is one."""
    columns, schema = docs.columns, docs.schema
    marks = _by_document(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).withColumnsRenamed({"doc": "__doc", "marks": "__marks"})
    at, chars = columns.index(text_col), columns.index(chars_col) if chars_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            arrays = batch.columns[: len(columns)]
            rows = zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)
            left = [cut(text or b"", marks)[0].decode("utf-8", "ignore") for text, marks in rows]
            arrays[at] = pa.array(left, pa.string())
            if chars is not None:
                arrays[chars] = pa.array([len(text) for text in left], pa.int64()).cast(batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.join(marks, docs[id_col].cast("long") == marks["__doc"], "left").drop("__doc").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without passages that start earlier."""
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
