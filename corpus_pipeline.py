"""A corpus pipeline over ``documents``: quality, repeated lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs; all but the last return the columns of ``documents``.  Rows without an id cannot
be named by a stage's decisions and stay; rows that share an id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, line_dedup, minhash_odd, quality_mil, sentencepiece_codec
from tidewater.llm.common import ship_package, table, written

PIECE_MODEL = "piece_bpe_32k.model"
#: Chunks that a worker's encoder remembers; the workers of the other stages are the same processes.
REMEMBERED = 220_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column, named as nothing else is)."""
    return docs.join(ids, docs["doc_id"] == ids["__gone_id"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_mil.keep_good(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them; ``n_chars`` follows the text."""
    return line_dedup.rewrite_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    found = minhash_odd.near_duplicates(docs, words=5)
    return _without(docs, found.where("NOT kept").select(F.col("doc_id").alias("__gone_id")).distinct())


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("__gone_id")).distinct())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path(PIECE_MODEL), remembered=REMEMBERED)


STAGES = [
    ("quality", quality),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Models, hashing of bands and tokenising are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
