"""Payload documents as VARIANT columns: parsed once, read by typed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the document that a text of JSON holds; null where the text is null or no JSON."""
    return df.withColumn(into, F.try_parse_json(F.col(text)))


def at(document: Column, path: str, kind: str) -> Column:
    """What a document holds at a path, as a type of Spark; null where there is nothing or it can't be of that type."""
    return F.try_variant_get(document, path, kind)


def fields(df: DataFrame, document: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each name: the document's value at (path, type)."""
    return df.withColumns({name: at(F.col(document), path, kind) for name, (path, kind) in paths.items()})


def entries(df: DataFrame, document: str, path: str, kind: str, keep: list[str]) -> DataFrame:
    """keep, pos and value: the elements of the array at a path, in order; documents without one give no rows."""
    values = F.try_variant_get(F.col(document), path, f"array<{kind}>")
    return df.select(*keep, F.posexplode(values).alias("pos", "value"))
