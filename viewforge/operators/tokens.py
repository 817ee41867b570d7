"""Token buckets, padding and encodings of views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = (128, 256, 512, 1024, 2048)


def checked_buckets(buckets: tuple[int, ...], most: int) -> list[int]:
    """Distinct positive lengths of at most `most`, ascending."""
    found = sorted(set(buckets))
    if not found or found[0] <= 0 or found[-1] > most:
        raise ValueError(f"bucket lengths must be positive and at most {most}")
    return found


def bucket_of(need: Column, buckets: list[int]) -> Column:
    """The smallest bucket that holds need, else the largest."""
    chain = F
    for length in sorted(buckets):
        chain = chain.when(need <= length, length)
    return chain.otherwise(max(buckets))


def batch_for(length: Column, batch_of: dict[int, int]) -> Column:
    """The batch size of a length: its own, else that of the next larger, else that of the largest."""
    chain = F
    for at, batch in sorted(batch_of.items()):
        chain = chain.when(length <= at, batch)
    return chain.otherwise(batch_of[max(batch_of)])


def parse_batches(text: str) -> dict[int, int]:
    """`length:batch` pairs, parted by commas; both positive."""
    found = {int(a): int(b) for a, b in (pair.split(":") for pair in text.split(",") if pair.strip())}
    if any(a <= 0 or b <= 0 for a, b in found.items()):
        raise ValueError("lengths and batches must be positive")
    return found


def clip_and_pad(ids: Column, length: Column | int, pad: int) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    cut = F.slice(ids, F.lit(1), length)
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("int"), (length - F.size(cut)).cast("int")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of value, which is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def byte_ids(data: Column) -> Column:
    """All bytes of a binary column, plus one."""

    def ids(x: Column) -> Column:
        # two hexadecimal digits a byte
        each = F.transform(F.sequence(F.lit(1), F.octet_length(x)), lambda i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("int") + 1)
        return F.when(F.octet_length(x) > 0, each).otherwise(F.array().cast("array<int>"))

    return once(data, ids)


def byte_tokens(text: Column, length: int) -> Column:
    """UTF-8 bytes plus one, cut at length and padded with zeros."""
    cut = F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, length)
    return once(byte_ids(cut), lambda t: clip_and_pad(t, length, 0))


def mode_tokens(body: Column, mode: Column, length: int, bos: int, eos: int, pad: int) -> Column:
    """bos, mode, eos, body, eos; body cut to fit, then padded."""
    room = F.slice(body, 1, length - 4)
    return clip_and_pad(F.concat(F.array(F.lit(bos), mode, F.lit(eos)), room, F.array(F.lit(eos))), length, pad)


def encode_views(triples: DataFrame, tokenizer_path: str, columns: tuple[str, ...] = ("anchor", "positive", "negative")) -> DataFrame:
    """triples with <column>_ids for each of columns, encoded whole by a tokenizer file."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in triples.schema] + [f"{c}_ids array<int>" for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for pdf in batches:
            yield pdf.assign(**{f"{c}_ids": [e.ids for e in tokenizer.encode_batch(pdf[c].tolist(), add_special_tokens=False)] for c in columns})

    return triples.mapInPandas(run, schema)


def bucketed(encoded: DataFrame, buckets: tuple[int, ...] = BUCKETS, pad: int = 0, columns: tuple[str, ...] = ("anchor", "positive", "negative")) -> DataFrame:
    """encoded with bucket_len, truncated and each of its ids cut and padded to the bucket."""
    lengths = checked_buckets(buckets, max(buckets))
    need = F.greatest(*(F.size(f"{c}_ids") for c in columns))
    rows = encoded.withColumns({"bucket_len": bucket_of(need, lengths), "truncated": need > max(lengths)})
    return rows.withColumns({f"{c}_ids": clip_and_pad(F.col(f"{c}_ids"), F.col("bucket_len"), pad) for c in columns})


def write_cache(rows: DataFrame, path: str, shard_rows: int = 10_000, overwrite: bool = False) -> None:
    """Bucketed rows as Parquet, one folder a bucket; a cache that is there is kept unless overwritten."""
    rows.repartition("bucket_len").write.mode("overwrite" if overwrite else "ignore").option("maxRecordsPerFile", shard_rows).partitionBy("bucket_len").parquet(path)


def check_cache(cache: DataFrame, vocabulary: int, longest: int, columns: tuple[str, ...] = ("anchor", "positive", "negative")) -> None:
    """Raises if a cache holds ids that a vocabulary lacks, or buckets longer than `longest`."""
    most = cache.agg(F.max(F.greatest(*(F.array_max(f"{c}_ids") for c in columns))).alias("id"), F.max("bucket_len").alias("length")).first()
    if most.id is not None and (most.id >= vocabulary or most.length > longest):
        raise ValueError(f"cache has id {most.id} and length {most.length}; at most {vocabulary - 1} and {longest} fit")
