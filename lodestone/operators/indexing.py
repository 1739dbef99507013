"""Incremental index builds: what is not yet in a collection is embedded and added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.operators.catalog import missing
from lodestone.operators.collection import VectorCollection


def embedded(cards: DataFrame, load: Callable[[], Callable[[list], list]], column: str, ident: str = "id") -> DataFrame:
    """(id, vector, payload null). ``load`` is called once a Python worker and gives a function from a batch of values of
    ``column`` to vectors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for part in parts:
            yield pd.DataFrame({"id": part[ident].astype(str), "vector": list(encode(list(part[column]))), "payload": pd.Series([None] * len(part), dtype=object)})

    return cards.select(ident, column).mapInPandas(run, VectorCollection.SCHEMA)


def build(collection: VectorCollection, cards: DataFrame, load: Callable[[], Callable[[list], list]], column: str, ident: str = "id") -> int:
    """Adds the cards whose id the collection lacks; gives how many."""
    todo = missing(cards.withColumn(ident, cards[ident].cast("string")), collection.points().select("id").withColumnRenamed("id", ident), ident)
    n = todo.count()
    if n:
        collection.upsert(embedded(todo, load, column, ident))
    return n
