"""A training corpus from raw documents, in five stages. Each stage's rows are written as Parquet and read again as the
next one's documents, so a lost executor costs at most a part of one stage."""

from __future__ import annotations

from lodestone.llm import boilerplate, byte_pairs, mixing, near_duplicates, scoring, toxicity
from lodestone.session import staged, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labelled rows that op10 learns from."""
    labels = table(spark, sf_dir, "labels")
    labels = labels.where(F.coalesce(scoring.crc_remainder("doc_id", 4) != 2, F.lit(True)))
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    return boilerplate.drop_boilerplate(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 80 % of its five-word shingles over links."""
    return near_duplicates.one_of_each(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit integers), their digest, and that of the decoded text, beside the other
    columns of docs but text and n_chars. Columns that have the new ones' names are replaced."""
    new = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    kept = [c for c in docs.columns if c not in ("text", "n_chars", *new)]
    out = byte_pairs.encode_texts(docs, byte_pairs.share_vocabulary(spark, byte_pairs.vocabulary_path()), decoded="decoded", keep=kept)
    return out.select(*kept, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_duplicates),
    ("mixing", to_target_weights),
    ("byte_pairs", encoded),
]

#: SQL expresses neither the classifier nor min-hash verification nor byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
