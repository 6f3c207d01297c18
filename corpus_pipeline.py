"""Cleaning pipeline for training text: each stage takes what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import bytepair, contamination, language, neardup, repeats
from proofloom.llm.tables import bounded_batches, read_ranks, stored, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, or no letter in it. Where no document to learn from has both
    a text and a language, there is nothing to judge by and all stay."""
    bounded_batches(spark)
    learn = F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))
    model = language.fit(docs, learn)
    if not model.names:
        return docs
    found = language.language(docs, model, pred="__lang", score="__share")
    return found.where(F.col("__lang") != language.UNKNOWN).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, similarity 0.8 or more."""
    bounded_batches(spark)
    return neardup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has too are cut out."""
    bounded_batches(spark)
    return repeats.deduplicated_text(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it. A null text has no ids and counts as decoded."""
    bounded_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bytepair.encode_checked(docs, ranks, public_tokenizers.PATTERN, spaced=True, ids="__ids", same="__same")
    return coded.select("doc_id", "lang", "source", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"), F.col("__same").alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
