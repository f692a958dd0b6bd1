"""The queries of this folder's operators for the driver, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, chat, html_extract, jaccard, license_scan, mixing, quality, topk, toxicity, url_filters
from strandframe.llm.common import table

#: A text with this score or a higher one is taken as toxic.
TOXIC = 0.3


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """The path of a public rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), *tokenizer(), decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", *bpe.digests(coded))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat.formatted_digests(rows.unionByName(more), *tokenizer())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_bpe, op3_mixing, op4_license_scan, op5_top_k, op6_toxicity, op7_ngram_jaccard, op8_chat_format, op9_quality_rules, op10_url_filters]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op4_license_scan": license_scan.oracle(), "op5_top_k": topk.ORACLE, "op8_chat_format": chat.ORACLE}
