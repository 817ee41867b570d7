"""The corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's docs. All but the last
return the columns of documents.

1. toxicity: rows that score THRESHOLD or more go. Labels of held-out rows are never
   learnt from.
2. exact_dedup: of texts equal but for the case of A-Z the largest doc_id stays.
3. near_dedup: of documents connected by five-word shingle similarity of 0.8 or more
   the smallest doc_id stays.
4. repeats: bytes covered by a 100-byte string that starts earlier are cut out, n_chars
   follows; a document that loses everything stays with an empty text.
5. packing: sequences of at most 4096 tokens, one row a piece.

doc_id and text name a document: rows that repeat both are kept, dropped and cut alike,
another text under the same doc_id is a document of its own. Rows without doc_id go as
copies of rows with one; those that resemble each other alone stay, and are not cut.
Null text counts as empty. Further columns are carried to stage 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm import exact_dedup, jaccard_join, packing, repeats, toxicity
from viewforge.llm.batches import lean
from viewforge.plans.scratch import discard, materialise, passing, small_side
from viewforge.sources.tables import table


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows of dropped (id, text_mark)."""
    gone = materialise(dropped.select(F.col("id").alias("__id"), F.col("text_mark").alias("__mark")).distinct(), "pipeline-dropped")
    gone = small_side(gone, 16)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__mark"]), "left_anti")


@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scorer = toxicity.fit(docs, labels, ~toxicity.held_out() & F.col("doc_id").isNotNull())
    return toxicity.clean_rows(docs, scorer)


@lean
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, exact_dedup.exact_groups(docs, keep="max").filter("not kept"))


@lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, jaccard_join.jaccard_components(docs).filter("not id <=> component_id"))


@lean
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


@lean
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL has no learnt classifier, shingle components or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with passing(spark) as keep:
            docs = keep(materialise(stage(spark, before, sf_dir), f"pipeline-{name}"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
