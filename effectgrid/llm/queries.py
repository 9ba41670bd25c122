"""The queries of this subpackage, by name: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectgrid.llm import (
    archives, decontaminate, divergence, exact_dedup, language, main_text, mixing, ngram_links, personal_data, quality, toxicity,
    url_rules, whitening,
)
from effectgrid.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links.ngram_joined(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.page_records(read(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("longest_match")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: a row of either has its own id and a null for the other's."""
    docs = language.document_rows(read(spark, sf_dir, "documents")).withColumn("kind", F.lit("document"))
    pages = language.page_rows(read(spark, sf_dir, "pages")).withColumn("kind", F.lit("page"))
    found = language.identify(docs.unionByName(pages))
    own = lambda kind: F.when(F.col("kind") == kind, F.col("key"))
    return found.select(
        own("document").alias("doc_id"), own("page").alias("page_id"), "declared", "host", "language", "text_language", "posterior", "accepted"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read(spark, sf_dir, "documents")).drop("shards")
    return found.withColumn("target", F.round("target", 6))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(read(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_personal_data": op6_personal_data,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality_ranking": op10_quality_ranking,
    "op11_url_filters": op11_url_filters,
    "op12_whitening": op12_whitening,
    "op13_source_divergence": op13_source_divergence,
}
