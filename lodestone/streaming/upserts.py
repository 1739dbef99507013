"""Streams into keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.operators.keyed_table import KeyedTable


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, order: list[str] | None = None, **trigger) -> StreamingQuery:
    """Each trigger's rows are one batch of the table, under the number that the stream gave it: a batch that is run again
    after a failure, wherever it failed, changes nothing. Of the rows of a key in one batch the last by ``order`` counts.
    The table is written by this stream alone; a new checkpoint needs a new table."""
    table.create()
    first = next(b for b, kind in reversed(table.log()) if kind == "create") + 1

    def merge(rows: DataFrame, batch: int) -> None:
        table.upsert(rows, first + batch, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
