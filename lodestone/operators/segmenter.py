"""Segmentation as a table function: frames in, a row for each segment out, by LATERAL joins from SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: label, confidence and outline of a segment.
SCHEMA = "label int, conf double, points array<struct<x: double, y: double>>"
Segment = tuple[int, float, list[tuple[float, float]]]


def bright_runs(width: int, least: int) -> Callable[[bytes], list[Segment]]:
    """A segmenter of 8-bit grey frames of a fixed width: each run of pixels of one row that are brighter than ``least`` is
    a segment, its confidence the mean brightness. A last row may be shorter."""

    def segments(frame: bytes) -> list[Segment]:
        out = []
        pixels = np.frombuffer(frame, dtype=np.uint8)
        for y in range(-(-len(pixels) // width)):
            row = pixels[y * width : (y + 1) * width]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (row > least).astype(np.int8), [0]])))
            for x0, x1 in edges.reshape(-1, 2).tolist():
                out.append((0, float(row[x0:x1].mean()) / 255, [(float(x0), float(y)), (float(x1), float(y)), (float(x1), y + 1.0), (float(x0), y + 1.0)]))
        return out

    return segments


def register(spark: SparkSession, name: str, load: Callable[[], Callable[[bytes], list[Segment] | None]]) -> None:
    """Makes ``name(frame)`` a table function of SQL that gives (label, conf, points) for each segment of a frame. ``load``
    is called once in each Python worker that meets the function, and gives the segmenter: a model is loaded there. A null
    frame has no segments, nor has one for which the segmenter gives none: it has no row in the result, in LEFT JOIN
    LATERAL neither, as Spark's table functions in Python have no outer form; join by key to keep such frames."""

    class Segments:
        def __init__(self):
            self.segment = load()

        def eval(self, frame: bytes) -> Iterator[tuple]:
            if frame is not None:
                for label, conf, points in self.segment(bytes(frame)) or ():
                    yield label, conf, [{"x": x, "y": y} for x, y in points]

    spark.udtf.register(name, udtf(Segments, returnType=SCHEMA, useArrow=True))
