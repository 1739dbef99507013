"""Frames of a stream against what a catalog holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recognised(frames: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """Each detection of the stream with the catalog's columns, read anew with each trigger; ``known`` tells whether the
    catalog has its key. Without state: a row that finds nothing goes out at once. Columns of the catalog that the frames
    have too are left out, and a key that the catalog repeats gives a row each."""
    more = [c for c in catalog.columns if c != key and c not in frames.columns]
    held = catalog.select(key, *more).where(F.col(key).isNotNull()).withColumn("known", F.lit(True))
    return frames.join(held, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
