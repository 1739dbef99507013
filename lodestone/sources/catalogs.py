"""Catalogs: raw JSON documents into a keyed table, loaded once and refreshed on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.keyed_table import KeyedTable

#: Of a stored catalog: the fields that queries use, and the whole document.
SCHEMA = "id string, name string, set_code string, set_name string, img_uri string, payload string"
#: Where a document holds the fields.
PATHS = {"id": "$.id", "name": "$.name", "set_code": "$.set", "set_name": "$.set_name", "img_uri": "$.image_uris.small"}


def documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(payload): a document a line, or (not ``lines``) the elements of one array in each file, as text. One file's array is
    read by one task, so large catalogs come as lines."""
    if lines:
        return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("payload"))
    whole = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("d"))
    return whole.select(F.explode("d").alias("d")).select(F.to_json("d").alias("payload"))


def load(spark: SparkSession, source: str, store: str, refresh: bool = False, lines: bool = True) -> DataFrame:
    """The catalog at ``store``: one row an id, the last of its documents. It is made from the documents at ``source`` where
    there is none yet, or when a refresh is asked for, which replaces it whole; else the source is not read. Documents that
    are no JSON, or have no id, are left out. Ids are in lower case."""
    table = KeyedTable(spark, store, SCHEMA, "id")
    if refresh or not table.exists():
        numbered = documents(spark, source, lines).withColumn("_at", F.monotonically_increasing_id()).withColumn("_d", F.try_parse_json("payload"))
        rows = numbered.select("_at", "payload", *[F.try_variant_get("_d", path, "string").alias(name) for name, path in PATHS.items()]).withColumn("id", F.lower(F.trim("id")))
        table.drop()
        table.create()
        table.upsert(rows, order=["_at"])
    return table.rows()
