"""State of streams, by key, with an expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Processing time after which state that nothing has touched is dropped.
TTL_MS = 10 * 60 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def with_state(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """Runs a processor over the rows of each key. Its state lives in RocksDB, the one store that keeps several variables a
    key and lets them expire. Two settings of the session change for the queries that start from here on: the provider of
    state, and that batches without rows are not run. With expiry Spark would run such batches without end, and a query
    that is to end with its input (availableNow) never would; expired state is not read in any case, and goes with the
    next batch that has rows. A query that needs batches without rows starts from another session."""
    spark = stream.sparkSession
    for name, value in ((_PROVIDER, _ROCKS), (_EMPTY_BATCHES, "false")):
        spark.conf.set(name, value)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "ProcessingTime")
