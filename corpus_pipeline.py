"""Corpus preparation: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes what the one before it kept and returns the columns of documents,
the last the encoded texts. Rows are told apart by doc_id and text, so null ids,
repeated rows and further columns pass through; a stage's operator says what it
does with empty texts, ties and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, passages, pieces, resample, simhash
from tidemark.llm.common import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; those that it rejects go."""
    return resample.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document without other words goes."""
    return passages.cut_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document that is left."""
    import public_tokenizers

    made = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]

#: No SQL: hashed n-gram models, SimHash, MinHash and SentencePiece are beyond it. tests/llm holds the operators of the stages against
#: brute force (the quality model against held-out labels), and what the stages do to the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        docs = materialize(made)
        discard(made)  # what the stage was read from
    return docs
