"""Time-gated running averages over streams, with state per key: the streaming form of the batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.state import TTL_MS, with_state


class GatedAverage(StatefulProcessor):
    """One value a key: when a row counted last, the average, and how many counted."""

    def __init__(self, key: str, at: str, value: str, gate: float, weight: float, ttl_ms: int | None):
        self.key, self.at, self.value, self.gate, self.weight, self.ttl_ms = key, at, value, gate, weight, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.average = handle.getValueState("average", "t double, z array<double>, n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, z, n = self.average.get() if self.average.exists() else (None, None, 0)
        new = pd.concat(list(rows)).dropna(subset=[self.at, self.value]).sort_values(self.at, kind="stable")
        for now, v in zip(new[self.at], new[self.value]):
            if t is None or now - t > self.gate:
                z = [float(x) for x in v] if z is None else [self.weight * float(x) + (1 - self.weight) * float(y) for x, y in zip(v, z)]
                t, n = float(now), n + 1
        if t is not None:
            self.average.update((t, z, n))
            yield pd.DataFrame({self.key: [key[0]], "t": [t], "z": [list(z)], "n": [n]})

    def close(self) -> None:
        pass


def gated_average(stream: DataFrame, key: str, at: str, value: str, gate: float, weight: float = 0.1, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(key, t, z, n) after each trigger that brings rows of a key. stream: key, ``at`` (a number), ``value`` (an array of
    doubles). Rows of one trigger are taken in order of ``at``; a row counts if it lies more than ``gate`` after the last
    that counted, the first always does. Rows with a null time or value are left out. The average of a key that nothing
    has come in for during ``ttl_ms`` of processing time is forgotten, and its next row is a first one; None keeps it for
    ever."""
    kind = dict(stream.dtypes)[key]
    return with_state(stream.select(key, at, value), [key], GatedAverage(key, at, value, gate, weight, ttl_ms), f"`{key}` {kind}, t double, z array<double>, n bigint", "update")


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and value; rows later than the watermark are left out."""
    held = stream.withWatermark(at, late)
    return held.groupBy(F.window(at, width, slide or width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
