"""The thirteen operators over their whole tables, with production parameters, and the pipeline that chains five of them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, boilerplate, byte_pairs, disclosure, mixing, near_duplicates, outliers, packing, scoring, toxicity, transport, url_lists, variants
from lodestone.session import table

def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(scoring.crc_remainder("doc_id", 5) == 1, F.lit(False))
    return scoring.score(docs, docs.where(~held_out)).withColumn("held_out", held_out)


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_lists.fetched_at(F.col("page_id")).alias("fetched_at"))
    return url_lists.judge(pages, url_lists.listed(spark).unionByName(url_lists.drawn_list(pages)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.span_digests(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_pairs.encode_texts(docs, byte_pairs.share_vocabulary(spark, byte_pairs.vocabulary_path()), keep=["doc_id"], digest=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boilerplate.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(scoring.crc_remainder("doc_id", 4) == 2, F.lit(False))
    return toxicity.toxicity(docs, labels.where(~held_out)).withColumn("held_out", held_out)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.share_ids(spark, byte_pairs.vocabulary_path()), keep=["doc_id"], digest=True)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scores": op1_lm_scores,
        "op2_url_lists": op2_url_lists,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_pii": op4_pii,
        "op5_bpe": op5_bpe,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_media": op9_media,
        "op10_toxicity": op10_toxicity,
        "op11_packing": op11_packing,
        "op12_alignment": op12_alignment,
        "op13_variants": op13_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_lists": url_lists.ORACLE, "op6_line_dedup": boilerplate.ORACLE, "op7_mixing": mixing.ORACLE}
