"""N-gram Jaccard join over a token-group matrix.

Texts become sets of hashed five-word shingles; equal sets are one class from then
on. Similar classes are brought together without losing a pair: the space of hashes
is cut into ranges, more of them than a qualifying pair can differ in, so a pair has
ranges with equal contents. A class emits a signature for as many of its ranges as
are needed to be sure that one of the equal ones is among them, the fullest first,
shingles known to be frequent counting for nothing in that order. Classes that share
a signature are connected; the connected sets hold every qualifying pair.

A connected set, or each pair of its blocks of at most BLOCK_CLASSES classes that
lengths allow to match, is then searched in one task. Classes are sorted by their
smallest shingles and cut into groups; the matrix from shingle to group holds each
group's union. A class's overlap with a union bounds its overlap with any member, so
only groups that reach the threshold, and hold a class not yet connected with it, are
opened and counted exactly. Links are verified by 100 * intersection >= percent *
union; only a spanning forest of them leaves a task.

Defined results: null text and text without words give an empty set, linked with
nothing; fewer words than a shingle make one shingle; repeated rows share their
class; texts under one identifier, or none, link like others, and a null identifier never
names a component unless all of its rows have none;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.llm.components import connected_components
from viewforge.llm.exact_dedup import N_RUNS, group_rows
from viewforge.plans.scratch import materialise, small_side
from viewforge.sources.tables import table

QUERY = "op4_jaccard_join"

WORDS = 5
PERCENT = 80
#: Ranges over what a pair may differ in, as a share.
SPARE = 0.25
#: The most frequent shingles known to all tasks (a hint for their order only).
FREQUENT = 50_000
GROUP_CLASSES = 32
BLOCK_CLASSES = 2_000
#: Classes whose copies a task leaves out; beyond them copies are emitted again.
KEPT_CLASSES = 200_000
CHUNK_BYTES = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte; capitals have that of their small letters.
_BYTE = np.random.default_rng(20_240_802).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, up to n."""
    if len(_POWERS[0]) < n:
        for k, m in enumerate((int(_ODD[7]), pow(int(_ODD[7]), -1, 1 << 64))):
            factors = np.full(max(n, CHUNK_BYTES), m, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of data, which ends in white space."""
    hashes, places, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK_BYTES)
        if stop < len(data):
            # a chunk ends behind white space; a word longer than a chunk stays whole
            ends = [data.rfind(c, at, stop) for c in (b" ", b"\n")]
            stop = 1 + max(ends) if max(ends) >= 0 else 1 + min((x for c in (b" ", b"\n") if (x := data.find(c, stop)) >= 0), default=len(data) - 1)
        part = np.frombuffer(data, np.uint8, stop - at, at)
        space = _SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        powers, inverse = _powers(len(part))
        sums = np.cumsum(_BYTE[part] * powers[: len(part)], dtype=np.uint64)
        before = np.where(starts > 0, sums[starts - 1], 0).astype(np.uint64)
        hashes.append(mix((sums[ends - 1] - before) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD[5]))
        places.append(starts + at)
        at = stop
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    parts = [text or b"" for text in texts]
    hashes, places = _word_hashes(b"".join(part + b"\n" for part in parts))
    cuts = np.searchsorted(places, np.concatenate([[0], np.cumsum([len(part) + 1 for part in parts])])).tolist()

    def joined(run: np.ndarray, n: int) -> np.ndarray:
        total = np.full(max(0, len(run) - n + 1), n, np.uint64)
        for k in range(n if len(total) else 0):
            total += run[k : len(run) - n + 1 + k] * _ODD[k % 8]
        return mix(total)

    every, out = joined(hashes, words), []
    for first, last in zip(cuts, cuts[1:], strict=False):
        n = last - first
        found = every[first : last - words + 1] if n >= words else joined(hashes[first:last], n) if n else hashes[:0]
        found = np.sort(found)
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found)
    return out


def differ_at_most(n: int, percent: int) -> int:
    """The most elements by which a set of n and a qualifying partner can differ."""
    larger = n * 100 // percent
    # J >= t needs an intersection of t / (1 + t) of both sizes
    return (n + larger) * (100 - percent) // (100 + percent)


def schemes_of(n: int, percent: int) -> list[int]:
    """The schemes (powers of two) in which sets of n meet partners."""
    own = n.bit_length() - 1
    return [own, own + 1] if n * 100 // percent >= 1 << (own + 1) else [own]


def ranges_of(scheme: int, percent: int) -> int:
    return math.ceil((1 + SPARE) * (differ_at_most((2 << scheme) - 1, percent) + 1))


def signatures(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of which any qualifying pair of unequal sets shares one."""
    n, out = len(shingles), []
    rare = np.ones(n, np.int64)
    if len(frequent):
        rare -= frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles, dtype=np.uint64)])
    for scheme in schemes_of(n, percent):
        k = ranges_of(scheme, percent)
        at = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        sizes = np.bincount(at.astype(np.int64), minlength=k)
        ends = np.cumsum(sizes)
        weights = np.bincount(at.astype(np.int64), weights=rare, minlength=k).astype(np.int64)
        best = np.argsort(-(weights * (1 << 24) + sizes), kind="stable")[: differ_at_most(n, percent) + 1]
        content = sums[ends[best]] - sums[ends[best] - sizes[best]]
        place = best.astype(np.uint64) * _ODD[0] + np.uint64((scheme * int(_ODD[1])) & (2**64 - 1)) + sizes[best].astype(np.uint64) * _ODD[2]
        out.append(mix(content ^ mix(place)))
    return np.concatenate(out)


def _set_mapper(words: int):
    """A row for each text: id, mark, n, set (128-bit digest), cls; and rows of shingles frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, marks, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()).to_pylist()
            sizes, digests, seen = [], [], {}
            for shingles in shingle_sets(texts, words):
                digest = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
                sizes.append(len(shingles))
                digests.append(digest)
                if digest:
                    seen[digest] = shingles
            classes = [d and int.from_bytes(d[:8], "little", signed=True) for d in digests]
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(classes, pa.int64()), none, none], names=["id", "mark", "n", "digest", "cls", "shingle", "df"])
            if seen:
                shingle, df = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                many = df >= max(4, len(seen) // 100)
                m = int(many.sum())
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(m, pa.binary()), none, pa.array(shingle[many].view(np.int64)), pa.array(df[many])], names=["id", "mark", "n", "digest", "cls", "shingle", "df"])

    return run


def _signature_mapper(words: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in small(batches):
            sigs, classes = [], []
            for shingles in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), words):
                digest = xxhash.xxh3_128_digest(shingles.tobytes())[:8]
                if len(shingles) and digest not in done:
                    if len(done) < KEPT_CLASSES:
                        done.add(digest)
                    sigs.append(signatures(shingles, frequent, percent))
                    classes.append(np.full(len(sigs[-1]), int.from_bytes(digest, "little", signed=True), np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(classes))], names=["sig", "cls"])

    return run


def _star_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sig and cls: an edge from every further class of a signature to its first."""
    last: tuple[int, int] | None = None
    held: list[np.ndarray] = []
    n_held = 0

    def flush() -> pa.RecordBatch:
        pairs = np.unique(np.ascontiguousarray(np.concatenate(held)).view("V16"))
        pairs = pairs.view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        starts = np.concatenate([[last is None or last[0] != sig[0]], sig[1:] != sig[:-1]])
        first = np.maximum.accumulate(np.where(starts, np.arange(len(sig)), -1))
        leader = np.where(first < 0, last[1] if last else 0, cls[np.maximum(first, 0)])
        edge = cls != leader
        if edge.any():
            held.append(np.column_stack([cls[edge], leader[edge]]))
            n_held += len(held[-1])
        last = int(sig[-1]), int(leader[-1])
        if n_held > 1_000_000:
            yield flush()
            held, n_held = [], 0
    if held:
        yield flush()


def _candidate_mapper(words: int):
    """The sets of candidate texts, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets, kept = [], []
            found = shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), words)
            for k, (shingles, digest) in enumerate(zip(found, batch.column(1).to_pylist(), strict=True)):
                shingles = shingles.tobytes()
                if xxhash.xxh3_128_digest(shingles) == digest:
                    sets.append(shingles)
                    kept.append(k)
            rest = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns[2:], pa.array(sets, pa.binary())], names=[*rest.schema.names[2:], "shingles"])

    return run


class GroupMatrix:
    """Groups of similar sets and the matrix from shingle to the groups whose union holds it."""

    def __init__(self, sets: list[np.ndarray], size: int):
        order = sorted(range(len(sets)), key=lambda k: (sets[k][:4].tolist(), k))
        self.groups = [order[k : k + size] for k in range(0, len(order), size)]
        self.sizes = [np.array([len(sets[k]) for k in g]) for g in self.groups]
        self.unions, self.members = [], []
        for group in self.groups:
            union, at = np.unique(np.concatenate([sets[k] for k in group]), return_inverse=True)
            held = np.zeros((len(group), len(union)), np.uint8)
            held[np.repeat(np.arange(len(group)), [len(sets[k]) for k in group]), at] = 1
            self.unions.append(union)
            self.members.append(held)
        every = np.concatenate(self.unions)
        of = np.repeat(np.arange(len(self.groups)), [len(u) for u in self.unions])
        by = np.argsort(every, kind="stable")
        self.shingles, begins = np.unique(every[by], return_index=True)
        self.begins = np.append(begins, len(by))
        self.of = of[by]

    def overlaps(self, query: np.ndarray) -> np.ndarray:
        """How many of the query's shingles each group's union holds."""
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        counts = self.begins[at + 1] - self.begins[at]
        if not counts.sum():
            return np.zeros(len(self.groups), np.int64)
        picks = np.repeat(self.begins[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.bincount(self.of[picks], minlength=len(self.groups))

    def opened(self, g: int, query: np.ndarray) -> np.ndarray:
        """The exact intersections of the query with the group's members."""
        union = self.unions[g]
        at = np.minimum(np.searchsorted(union, query), len(union) - 1)
        return self.members[g][:, at[union[at] == query]].sum(1, dtype=np.int64)


def linked_roots(sets: list[np.ndarray], of_first: np.ndarray, of_second: np.ndarray, percent: int, group: int) -> list[int]:
    """For each set the index of one it is connected with by links between the first and the second."""
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    second = np.flatnonzero(of_second).tolist()
    matrix = GroupMatrix([sets[k] for k in second], group)
    for q in np.flatnonzero(of_first).tolist():
        n = len(sets[q])
        overlaps = matrix.overlaps(sets[q])
        for g in np.flatnonzero(overlaps * 100 >= percent * n).tolist():
            members = [second[k] for k in matrix.groups[g]]
            mine = find(q)
            if all(find(k) == mine for k in members):
                continue
            shared = matrix.opened(g, sets[q])
            for k in np.flatnonzero(100 * shared >= percent * (n + matrix.sizes[g] - shared)).tolist():
                a, b = find(q), find(members[k])
                if a != b:
                    root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(sets))]


def _search(percent: int, group: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", ignore_index=True)
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        block, (_, one, other) = pdf["block"].to_numpy(), key
        roots = linked_roots(sets, block == one, block == other, percent, group)
        cls = pdf["cls"].to_numpy()
        linked = [k for k, r in enumerate(roots) if r != k]
        return pd.DataFrame({"a": cls[linked], "b": cls[[roots[k] for k in linked]]}).astype("int64")

    return run


def _blocked(candidates: DataFrame, percent: int, block_classes: int) -> DataFrame:
    """candidates (comp, cls, n, ...) with block, and a row for each pair of blocks one <= other it belongs to.

    Sets of at most block_classes classes are one block. Others are cut by length, so
    that only neighbouring lengths can match, and within a length by hash.
    """
    whole = candidates.groupBy("comp").agg(F.count("*").alias("classes"))
    band = F.when(F.col("classes") <= block_classes, 0).otherwise(F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9)).cast("long")
    placed = candidates.join(whole, "comp").withColumn("band", band)
    cuts = materialise(placed.groupBy("comp", "band").agg(F.ceil(F.count("*") / block_classes).cast("long").alias("cuts")), "jaccard-blocks")
    for step, name in ((0, "cuts"), (1, "above"), (-1, "below")):
        side = cuts.select("comp", (F.col("band") - step).alias("band"), F.col("cuts").alias(name))
        placed = placed.join(side, ["comp", "band"], "left")

    def block(b, cut):
        return b * 1_000_000 + cut

    def blocks(b, cuts):
        return F.when(F.coalesce(cuts, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0).cast("long"), cuts - 1), lambda c: block(b, c))).otherwise(F.array().cast("array<bigint>"))

    own = block(F.col("band"), F.pmod(F.xxhash64("cls"), F.col("cuts")))
    partners = F.concat(blocks(F.col("band"), F.col("cuts")), blocks(F.col("band") + 1, F.col("above")), blocks(F.col("band") - 1, F.col("below")))
    return (
        placed.withColumn("block", own)
        .withColumn("with", F.explode(partners))
        .withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")})
        .drop("with", "band", "cuts", "above", "below", "classes")
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block_classes: int = BLOCK_CLASSES, group_classes: int = GROUP_CLASSES) -> DataFrame:
    """id, n_shingles, component_id and text_mark (xxhash64 of the text) of every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(N_RUNS)).cast("int")
    sets = marked.select("id", "mark", "text").mapInArrow(_set_mapper(words), "id long, mark long, n long, digest binary, cls long, shingle long, df long")
    seen = materialise(sets.withColumn("run", dealt), "jaccard-sets")
    often = seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "shingle").limit(FREQUENT).select("shingle").toPandas()
    frequent = np.sort(often["shingle"].to_numpy(np.int64).view(np.uint64))
    rows = seen.filter("shingle is null").select("id", "mark", "n", "digest", "cls", "run")

    pairs = texts.select("text").mapInArrow(_signature_mapper(words, percent, frequent), "sig long, cls long")
    stars = pairs.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_star_mapper, "a long, b long")
    near = connected_components(stars).select(F.col("node").alias("cls"), F.col("component").alias("comp"))

    members = materialise(group_rows(rows.filter("n > 0"), ["digest"], "min"), "jaccard-classes")
    first = members.filter(F.col("id").eqNullSafe(F.col("best"))).groupBy("digest", "n", "cls").agg(F.min(F.struct("id", "mark")).alias("row"))
    classes = first.select("row.id", "row.mark", "n", "digest", "cls")
    chosen = materialise(classes.join(near, "cls"), "jaccard-candidates")
    wanted = small_side(chosen.withColumnsRenamed({"id": "first_id", "mark": "first_mark"}), 72)
    held = marked.join(wanted, (marked["mark"] == wanted["first_mark"]) & marked["id"].eqNullSafe(wanted["first_id"]))
    found = held.select("text", "digest", "cls", "n", "comp").mapInArrow(_candidate_mapper(words), "cls long, n long, comp long, shingles binary")
    met = _blocked(materialise(found.dropDuplicates(["cls"]), "jaccard-searched"), percent, block_classes)
    links = met.groupBy("comp", "one", "other").applyInPandas(_search(percent, group_classes), "a long, b long")
    linked = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    named = chosen.join(linked, "cls").select("cls", "root", "id")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    known = materialise(named.select("cls", "root").join(least, "root").select("cls", "component_id").distinct(), "jaccard-components")
    done = members.join(small_side(known, 16), "cls", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "best").alias("component_id"), F.col("mark").alias("text_mark"))
    return done.unionByName(rows.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("mark").alias("text_mark")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_mark").withColumnRenamed("id", "doc_id")
