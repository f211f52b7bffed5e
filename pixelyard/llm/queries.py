"""Queries of this subpackage for __spark_entry__.py: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compression_quality import quality_model, score_quality
from .decontamination import contamination, find_contamination
from .html_layout import extract_text
from .inner_products import top_inner_products
from .licences import scan_licences
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .oracles import ORACLES  # noqa: F401
from .phrase_automata import phrase_dedup
from .suffix_array import suffix_array_dedup
from .toxicity import detect_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_array_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op4_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_licence_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrase_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op9_classifier_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_wu_manber_decontamination": op2_wu_manber_decontamination,
    "op3_top_inner_products": op3_top_inner_products,
    "op4_fair_queue_mixing": op4_fair_queue_mixing,
    "op5_html_layout": op5_html_layout,
    "op6_licence_diagonals": op6_licence_diagonals,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_classifier_chain_toxicity": op9_classifier_chain_toxicity,
    "op10_compression_quality": op10_compression_quality,
}
