"""The registered ``opN_<name>`` queries: each applies its operator, with production parameters,
to its whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import (decontaminate, fill_middle, filter_audit, html_extract, line_dedup, minhash_odd, oracle, pivot_topk, quality_mil,
                           sentencepiece_codec, suffix_dedup, url_reputation, warc, window_packing)
from tidewater.llm.common import ship_package, table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0)


def op4_minhash_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_odd.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page's labelled outcome is the label under its id: bad if of low quality or toxic
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.expr("CAST(size(spans) / 2 AS BIGINT)").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pivot_topk": op3_pivot_topk,
    "op4_minhash_odd": op4_minhash_odd,
    "op5_url_reputation": op5_url_reputation,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_mil": op8_quality_mil,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_window_packing": op12_window_packing,
    "op13_fill_middle": op13_fill_middle,
}

QUERIES = {name: _ready(query) for name, query in _OPERATORS.items()}

ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
