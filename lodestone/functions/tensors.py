"""Column functions over images and other tensors that are held as flat arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def channels_first(values: Column, pixels: int, channels: int) -> Column:
    """Pixel after pixel to channel after channel."""
    return F.transform(F.sequence(F.lit(0), F.lit(pixels * channels - 1)), lambda i: F.get(values, (i % pixels * channels + F.floor(i / pixels)).cast("int")))


def padded(values: Column, size: int, fill: float = 0.0) -> Column:
    """Filled at the end, or cut, to a size; as doubles."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(values, i).cast("double"), F.lit(fill)))


def bytes_bgr(pixel: Column) -> Column:
    """Values times 255, cut to integers and wrapped into a byte, the last channel first."""
    return F.transform(F.reverse(pixel), lambda x: F.pmod((x * 255).cast("long"), F.lit(256)).cast("int"))


def segments(df: DataFrame, masks: str, boxes: str) -> DataFrame:
    """A row a segment, with its place as label; none where either array is null."""
    both = df.where(F.col(masks).isNotNull() & F.col(boxes).isNotNull())
    kept = [c for c in df.columns if c not in (masks, boxes)]
    zipped = F.arrays_zip(F.col(masks).alias("mask"), F.col(boxes).alias("box"))
    return both.select(*kept, F.posexplode(zipped).alias("label", "s")).select(*kept, "label", F.col("s.mask").alias("mask"), F.col("s.box").alias("box"))


def corner_radius(width: Column, height: Column, ratio: float) -> Column:
    return F.ceil(F.greatest(width, height) * ratio).cast("int")


def round_mask(width: Column, height: Column, ratio: float) -> Column:
    """Row by row, whether a pixel lies in the rectangle with round corners: quarters of a disc around the innermost pixel of
    a tile of radius by radius pixels in each corner."""
    r = corner_radius(width, height, ratio)
    off = lambda i, n: F.greatest(F.lit(0), r - 1 - i, i - (n - r)).cast("double")
    row = lambda y: F.transform(F.sequence(F.lit(0), width - 1), lambda x: off(x, width) ** 2 + off(y, height) ** 2 <= (r * r).cast("double"))
    return F.flatten(F.transform(F.sequence(F.lit(0), height - 1), row))
