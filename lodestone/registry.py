"""The engine's own queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import details, matching, payloads, record, relational, shapes, vectors  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(record.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(record.ORACLES)


def recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: nearest catalog entries of query vectors, confident ones only."""
    return vectors.topk_join_catalog(spark, sf_dir).where("score > 0.1")
