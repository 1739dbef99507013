"""A keyed table of plain Parquet folders: upserts are appended, the last row of a key counts.

``rows/batch=<n>`` holds what one upsert brought, ``log`` one small row for each upsert that ended. A batch counts once the
log names it, so a reader never sees a part of one; writing a batch again replaces its folder, and a batch that the log
names is not written again. That makes a replayed batch harmless. An upsert costs what it brings, not what the table
holds; reading takes the last row of each key, and ``compact`` writes the table as one batch.

One writer at a time. Everything goes through Spark's own readers and writers, so the table may lie in any store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.operators import catalog

_LOG = StructType([StructField("batch", LongType()), StructField("kind", StringType())])


class KeyedTable:
    """``schema`` (DDL) of the rows, ``key`` one of its columns. Rows with a null key are left out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)

    def log(self) -> list[tuple[int, str]]:
        """(batch, kind) in order; empty where there is no table. One row an upsert since the last compaction."""
        try:
            found = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").distinct().collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = []
        return sorted((r["batch"], r["kind"]) for r in found)

    def _note(self, batch: int, kind: str) -> None:
        self.spark.createDataFrame([(batch, kind)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def exists(self) -> bool:
        held = self.log()
        return bool(held) and held[-1][1] != "drop"

    def next_batch(self) -> int:
        held = self.log()
        return held[-1][0] + 1 if held else 0

    def create(self) -> None:
        """Does nothing where the table exists."""
        if not self.exists():
            self._note(self.next_batch(), "create")

    def drop(self) -> None:
        """What was written before counts no more; its folders stay for readers that are still at work."""
        if self.exists():
            self._note(self.next_batch(), "drop")

    def upsert(self, rows: DataFrame, batch: int | None = None, order: list[str] | None = None) -> bool:
        """Inserts or replaces by key; of several rows of a key the last by ``order`` counts, else the largest. Gives whether
        the batch was new: one that the log names changes nothing. Without a number it is the next one."""
        batch = self.next_batch() if batch is None else batch
        if any(b == batch and kind == "upsert" for b, kind in self.log()):
            return False
        names = self.schema.names
        rest = [c for c in names if c != self.key]
        by = F.struct(*(order or []), *rest)
        new = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(self.key, "r.*").select(*names)
        new.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self._note(batch, "upsert")
        return True

    def rows(self) -> DataFrame:
        """The last row of each key. Batches that no log row names, and those before the last drop or compaction, are not
        read."""
        held = self.log()
        if not held or held[-1][1] == "drop":
            raise ValueError(f"no table at {self.path}")
        since = max([b for b, kind in held if kind in ("create", "compact", "drop")], default=-1)
        alive = [b for b, kind in held if kind == "compact" and b == since or kind == "upsert" and b > since]
        if not alive:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={b}" for b in alive])
        if len(alive) == 1:
            return read.select(*self.schema.names)
        return catalog.last_by(read, self.key, ["batch"]).select(*self.schema.names)

    def compact(self) -> None:
        """Writes the table as one batch; the log starts anew with it."""
        now, batch = self.rows(), self.next_batch()
        now.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self._note(batch, "compact")
