"""Catalog operators: grouping, dense labels, last-wins lookup, hard negatives, incremental indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.ranges import ringed
from lodestone.session import staged


def grouped(df: DataFrame, by: str, ident: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("min_id"), F.max(ident).alias("max_id"))


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): 0-based index of each distinct value in order; nulls have none. Values are dealt out by ranges and
    ranked within them, and only the sizes of the ranges (one number a task) are summed in one place."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = staged(values.repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(column))
    return ranged.join(F.broadcast(before), "_range").select(column, (F.col("_before") + rank - 1).cast("long").alias(name))


def with_dense_labels(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    for column, name in columns.items():
        df = df.join(dense_index(df, column, name), column, "left")
    return df


def last_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. One comparison per row, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def similar(df: DataFrame, ident: str, by: str, draw: Column) -> DataFrame:
    """Each id with one other id of its group, or null. Members of a group are ordered by a seeded draw and each takes
    the next one round, so a group of n gives n rows, not n squared, and pairs differ between seeds. Groups are dealt out
    by ranges, so a hot one is spread over tasks."""
    ring = ringed(df.select(ident, by, draw.alias("_draw")), by, ["_draw", ident], ident, "_next")
    return ring.select(ident, by, F.nullif(F.col("_next"), F.col(ident)).alias("other_id"))


def missing(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return wanted.join(existing, key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; others are added."""
    return old.join(new, key, "left_anti").unionByName(new)


def overwritten(points: DataFrame, payloads: DataFrame, key: str, column: str) -> DataFrame:
    """Whole payloads are replaced where a new one is given, even by null."""
    new = payloads.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    return points.join(new, points[key] == new["_key"], "left").select(*[F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(points[c]).alias(c) if c == column else points[c] for c in points.columns])


def retrieved(points: DataFrame, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the ids that exist, each once however often it is asked for; only ``columns`` are read besides the key."""
    return points.select(key, *columns).join(ids.select(key).distinct(), key, "left_semi")


def symbology(records: DataFrame, symbol: str = "symbol", uri: str = "svg_uri") -> DataFrame:
    """(token, uri): one row a symbol, the first address of several; null and empty symbols are none."""
    return records.where(F.col(symbol) != "").groupBy(F.col(symbol).alias("token")).agg(F.min(uri).alias("uri"))


def substituted(df: DataFrame, key: str, text: str, symbols: DataFrame) -> DataFrame:
    """(key, pos, item): characters and symbols in braces of each text, in order. A symbol of ``symbols`` (token, uri; each
    token once) becomes its uri, another one stays as it is, and so does a brace that nothing closes: joined, the items
    that are no uris give back the text. Null and empty texts give nothing; without any symbols, a text stays whole."""
    held = F.broadcast(symbols.agg(F.count(F.lit(1)).alias("_symbols")))  # one row
    cut = F.when(F.col("_symbols") == 0, F.array(F.col(text))).otherwise(T.tokens(F.col(text)))
    items = df.where(F.col(text) != "").crossJoin(held).select(key, F.posexplode(cut).alias("pos", "token"))
    return items.join(symbols.select("token", "uri"), "token", "left").select(key, "pos", F.coalesce("uri", "token").alias("item"))


def augmented(df: DataFrame, key: str, text: str, extra: str, symbols: DataFrame) -> DataFrame:
    """df with the items of its texts in ``extra``, an array, where that is null. Keys are unique."""
    todo = substituted(df.where(F.col(extra).isNull()), key, text, symbols)
    made = todo.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("_made"))
    joined = df.join(made, key, "left")
    return joined.withColumn(extra, F.coalesce(extra, "_made", F.array().cast("array<string>"))).drop("_made")
