"""Deterministic sampling, shuffling and batching by hash order.

A seed and a row's identifier give its place; nothing else does, so any part of a
sample or epoch can be computed again alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewforge.operators.ranking import running
from viewforge.operators.tokens import once


def draw(seed: int, *parts: Column) -> Column:
    """A row's place in the order of seed: hexadecimal SHA-256."""
    pieces = [F.lit(str(seed)), *(p.cast("string") for p in parts)]
    return F.sha2(F.concat_ws(":", *pieces), 256)


def uniform(seed: int, *parts: Column) -> Column:
    """A row's number in [0, 1), from 13 hexadecimal digits."""
    return F.conv(F.substring(draw(seed, *parts), 1, 13), 16, 10).cast("double") / float(16**13)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, each as likely as any other; all rows if there are no more."""
    return rows.withColumn("draw", draw(seed, F.col(key))).orderBy("draw").limit(n)


def epoch_batches(rows: DataFrame, key: str, shard: str, batch: int, seed: int, epoch: int) -> DataFrame:
    """rows with batch and position, shards in hash order, rows in hash order in a shard; a short last batch goes."""
    mixed = rows.withColumns({"__s": draw(seed, F.lit(f"{epoch}/shard"), F.col(shard)), "__r": draw(seed, F.lit(f"{epoch}/row"), F.col(key))})
    placed = running(mixed, [F.col("__s"), F.col("__r"), F.col(key)])
    full = F.floor(F.lit(rows.count()) / batch) * batch
    at = F.col("rn") - 1
    return placed.filter(at < full).withColumns({"batch": F.floor(at / batch).cast("long"), "position": (at % batch).cast("long")}).drop("__s", "__r", "rn")


def bucket_batches(rows: DataFrame, key: str, bucket: str, batch_of: dict[int, int], seed: int, epoch: int) -> DataFrame:
    """As epoch_batches, each bucket by itself with its own batch size; buckets with less than a batch go."""
    out = None
    for length, batch in sorted(batch_of.items()):
        part = epoch_batches(rows.filter(F.col(bucket) == length), key, bucket, batch, seed, epoch)
        out = part if out is None else out.unionByName(part)
    return out


def stride(rows: DataFrame, order: list[Column], rank: int, world: int) -> DataFrame:
    """Every world-th row in the order, from row `rank`."""
    return running(rows, order).filter(F.pmod(F.col("rn") - 1, F.lit(world)) == rank).drop("rn")


def alpha_weights(counts: DataFrame, alpha: float = 0.7) -> DataFrame:
    """counts (language, n) with weight, n to the power alpha over the sum of all."""
    power = F.pow(F.col("n").cast("double"), F.lit(alpha))
    # one row
    total = counts.agg(F.sum(power).alias("__t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("weight", power / F.col("__t")).drop("__t")


def mixture(rows: DataFrame, language: str, key: str, alpha: float, seed: int) -> DataFrame:
    """rows thinned so that languages occur in proportion to their alpha weights."""
    counts = alpha_weights(rows.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n")), alpha)
    rate = counts.withColumn("__rate", F.col("weight") / F.col("n"))
    most = rate.agg(F.max("__rate").alias("__most"))
    share = rate.crossJoin(F.broadcast(most)).select(F.col("language").alias("__l"), (F.col("__rate") / F.col("__most")).alias("__share"))
    return rows.join(share, F.col(language) == F.col("__l")).filter(uniform(seed, F.col(key)) < F.col("__share")).drop("__l", "__share")


def label_triplets(rows: DataFrame, seed: int) -> DataFrame:
    """For each row (id, label) of a label with two rows or more: a positive of that label, a negative of another.

    Rows of a label stand in hash order; the positive is the next one round. Labels
    stand in hash order, one small row each; the negative is the row of the next label
    at the same place, round again.
    """
    order = Window.partitionBy("label").orderBy(draw(seed, F.col("id")), "id")
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    labels = running(counts, [draw(seed, F.lit("label"), F.col("label")), F.col("label")]).withColumn("li", F.col("rn") - 1).drop("rn")
    n_labels = labels.count()
    if n_labels < 2:
        raise ValueError("label triplets need at least two labels with two rows each")
    placed = rows.join(labels, "label").withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    by_place = placed.select("li", "at", F.col("id").alias("other"))
    nexts = labels.select(F.pmod(F.col("li") - 1, F.lit(n_labels)).alias("li"), F.col("li").alias("neg_li"), F.col("n").alias("neg_n"))
    want = placed.join(nexts, "li").select(F.col("id").alias("anchor"), "label", "li", ((F.col("at") + 1) % F.col("n")).alias("pos_at"), "neg_li", (F.col("at") % F.col("neg_n")).alias("neg_at"))
    positive = by_place.select("li", F.col("at").alias("pos_at"), F.col("other").alias("positive"))
    negative = by_place.select(F.col("li").alias("neg_li"), F.col("at").alias("neg_at"), F.col("other").alias("negative"))
    return want.join(positive, ["li", "pos_at"]).join(negative, ["neg_li", "neg_at"]).select("anchor", "positive", "negative", "label")


def mask_tokens(tokens: Column, key: Column, vocabulary: int, mask_id: int, share: float = 0.15, seed: int = 0) -> Column:
    """tokens with about share of them masked: of ten, eight as mask_id, one at random, one as it is; one at least."""

    def pick(x: Column, i: Column, chosen: Column) -> Column:
        kind = uniform(seed + 1, key, i)
        other = F.floor(uniform(seed + 2, key, i) * vocabulary).cast("int")
        return F.struct(F.when(chosen & (kind < 0.8), F.lit(mask_id)).when(chosen & (kind < 0.9), other).otherwise(x).alias("token"), F.when(chosen, x).otherwise(-100).alias("target"))

    def mask(t: Column) -> Column:
        drawn = F.transform(t, lambda _, i: uniform(seed, key, i) < share)
        first = F.floor(uniform(seed + 3, key) * F.size(t)).cast("int")
        draws = F.struct(drawn.alias("drawn"), first.alias("first"))
        # whether any is drawn is asked at one place only, so the work stays linear in the tokens
        each = once(draws, lambda d: F.transform(t, lambda x, i: pick(x, i, d["drawn"][i] | ((i == d["first"]) & ~F.exists(d["drawn"], lambda y: y)))))
        return F.when(F.size(t) > 0, each)

    return once(tokens, mask)


def chunks(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """rows with chunk and position, n rows a chunk in the order; a short last chunk stays."""
    at = F.col("rn") - 1
    return running(rows, order).withColumns({"chunk": F.floor(at / n).cast("long"), "position": (at % n).cast("long")}).drop("rn")


def draws(rows: DataFrame, order: list[Column], n: int, seed: int) -> DataFrame:
    """n rows drawn one by one from all, with replacement: draw, its number, and the row."""
    placed = running(rows, order)
    wanted = rows.sparkSession.range(n).select(F.col("id").alias("draw"))
    wanted = wanted.withColumn("rn", F.floor(uniform(seed, F.col("draw")) * rows.count()).cast("long") + 1)
    return placed.join(wanted, "rn").select("draw", *rows.columns)
