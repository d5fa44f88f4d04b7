"""A training corpus from ``documents``: language ID, exact dedup, near dedup, mixing, packing.

Each stage works on all that the one before it kept, and its result is written
as a table and read again.  All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

Where ids repeat or are null, rows get a key of their own that orders like the
id, so each row is decided upon by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import exactdedup, jaccard, langid, mixing, packing
from strataloom.llm.queries import remainder, table, vocabulary
from strataloom.llm.shared import keep_rows, keyed, staged, take

#: A document whose most likely language has a lower posterior is rejected.
LEAST_POSTERIOR = 0.5
#: Smaller than the operator's own, as executors here have held the other stages' data before; both bound memory alone.
PACK_WORDS, PACK_BLOCK = 200_000, 1 << 20
KEY, LANGUAGE, POSTERIOR = "_row_key", "_predicted_language", "_posterior"


def rows_with_key(docs: DataFrame, *names: str) -> DataFrame:
    """The key as doc_id, and the named columns."""
    return take(docs, KEY, *names).withColumnRenamed(KEY, "doc_id")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose most likely language has a posterior of at least ``LEAST_POSTERIOR``."""
    known = take(docs, "doc_id", "text", "lang").filter(remainder(5) != 0)
    told = langid.predictions(docs, langid.learn(known, vocabulary("piece_bpe_32k.model")), LANGUAGE, POSTERIOR)
    return told.filter((F.col(LANGUAGE) != "und") & (F.col(POSTERIOR) >= LEAST_POSTERIOR)).drop(LANGUAGE, POSTERIOR)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest, then the one with the smallest id."""
    rows = keyed(docs, KEY)
    found = exactdedup.exact_duplicates(rows_with_key(rows, "text"))
    return keep_rows(rows, found.select(F.col("doc_id").alias(KEY), "kept"), KEY).drop(KEY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by shingle sets with a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    rows = keyed(docs, KEY)
    found = staged(jaccard.jaccard_components(rows_with_key(rows, "text")), "near")
    return keep_rows(rows, found.select(F.col("doc_id").alias(KEY), (F.col("doc_id") == F.col("component_id")).alias("kept")), KEY).drop(KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: a copy of which at least half the words are taken stays."""
    rows = keyed(docs, KEY)
    mixed = mixing.mix(rows_with_key(rows, "source", "text"))
    copies = mixed.select(F.col("doc_id").alias(KEY), F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("_copies")).filter("_copies > 0")
    repeated = rows.join(copies.hint("shuffle_hash"), KEY).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.drop(KEY, "_copies", "_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2, kept_words=PACK_WORDS, block=PACK_BLOCK)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Language ID, near dedup and packing have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
