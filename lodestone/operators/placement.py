"""Sequential placement as rounds: candidates are tried in order and one is taken unless one taken before is in its way.

A plain loop decides candidate after candidate. Whether a candidate is taken depends on earlier ones only, so all those
that have no undecided earlier conflict can be decided at once: they are taken, what they are in the way of falls, and the
rest goes into the next round. The result is that of the loop; the number of rounds is the longest chain of conflicts that
hang on one another, not the number of candidates. Each round is staged. Joins are by sorted merges: idents compress so
well that Spark would take millions of them for small enough to be broadcast, which fills the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import clipping
from lodestone.operators.boxes import overlapping
from lodestone.session import staged


def hides(new: clipping.Polygons, old: clipping.Polygons, new_seen: np.ndarray, new_area: np.ndarray, old_area: np.ndarray, least_visible: float, no_contains: bool) -> np.ndarray:
    """Row by row whether a card that is already placed (old) is in the way of a new one, given by what the image shows of
    it, with that part's area and the whole card's: too little of either would stay visible, or one contains the other."""
    shared = clipping.area(clipping.intersection(new, old))
    out = ((new_seen - shared) / new_area < least_visible) | ((old_area - shared) / old_area < least_visible) | clipping.holds(new, old)
    return out | clipping.holds(old, new) if no_contains else out


def taken_in_order(candidates: DataFrame, conflicts: DataFrame, ident: str, item: list[str]) -> tuple[DataFrame, int]:
    """candidates: ident (unique; its order is the order of the loop) and item columns: of each item one candidate is taken
    at most, an earlier one first. conflicts: (earlier, later) idents. Gives the taken ones as (ident, round), and the
    number of rounds."""
    todo, links, taken, rounds = staged(candidates.select(ident, *item), "undecided"), staged(conflicts.select("earlier", "later").distinct(), "conflicts"), None, 0
    while not todo.isEmpty():
        rounds += 1
        first = todo.groupBy(*item).agg(F.min(ident).alias(ident))
        free = staged(first.select(ident, *item).join(links.select(F.col("later").alias(ident)).hint("merge"), ident, "left_anti"), "taken")
        fallen = links.join(free.select(F.col(ident).alias("earlier")).hint("merge"), "earlier", "left_semi").select(F.col("later").alias(ident)).distinct()
        todo = staged(todo.join(free.select(*item).hint("merge"), item, "left_anti").join(fallen.hint("merge"), ident, "left_anti").select(ident, *item), "undecided")
        alive = todo.select(ident)
        links = staged(links.join(alive.withColumnRenamed(ident, "earlier").hint("merge"), "earlier", "left_semi").join(alive.withColumnRenamed(ident, "later").hint("merge"), "later", "left_semi").select("earlier", "later"), "conflicts")
        new = free.select(ident, F.lit(rounds).alias("round"))
        taken = new if taken is None else taken.unionByName(new)
    return (taken if taken is not None else todo.select(ident, F.lit(0).alias("round")).limit(0)), rounds


def place(candidates: DataFrame, image: str, item: str, ident: str, polygon: str, width: float, height: float, least_visible: float = 0.5, least_in_image: float = 1.0, no_contains: bool = True) -> DataFrame:
    """The candidates that end up on each image, with the ``round`` that decided them: all their columns.

    candidates: convex polygons by image, several attempts an item, tried in the order of ``ident`` (unique). An attempt
    fails if less than ``least_in_image`` (or ``least_visible``, if that is more) of it lies within the image, or if a card placed before hides it or is hidden by
    it (``least_visible`` of either has to stay), or if one contains the other. Conflicts are sought only where bounding
    boxes meet. Null polygons, those with a null or NaN, and those without area are never placed.
    """
    least_in_image = max(least_in_image, least_visible)
    given = candidates.select(ident, image, item, clipping.flat(F.col(polygon)).alias("_p")).where("_p is not null")
    box = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])

    def show(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p = clipping.padded(part.column("_p"))
            frame = np.broadcast_to(np.array([[0.0, 0.0], [width, 0.0], [width, height], [0.0, height]]), (part.num_rows, 4, 2)), np.full(part.num_rows, 4)
            v = clipping.intersection(p, frame)
            whole = (np.arange(p[0].shape[1]) < p[1][:, None])[..., None]
            low, high = np.where(whole, p[0], np.inf).min(axis=1), np.where(whole, p[0], -np.inf).max(axis=1)
            boxes = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(e)) for e in (low[:, 0], low[:, 1], high[:, 0], high[:, 1])], fields=list(box))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(clipping.area(p)), clipping.flattened(v), boxes, pa.array(clipping.area(v))], names=[*part.schema.names, "_area", "_v", "_box", "_seen"])

    fields = StructType([*given.schema.fields, *StructType.fromDDL("_area double, _v array<double>, _box struct<x0: double, y0: double, x1: double, y1: double>, _seen double").fields])
    shown = staged(given.mapInArrow(show, fields), "shown").where((F.col("_area") > 0) & (F.round(F.col("_seen") / F.col("_area"), 12) >= least_in_image))
    old, new = F.col("l"), F.col("r")
    met = overlapping(shown, [image], ident, "_box", only=old[item] != new[item], closed=True)
    pairs = met.select(old[ident].alias("earlier"), new[ident].alias("later"), new["_v"].alias("v"), old["_p"].alias("p"), new["_seen"].alias("seen"), new["_area"].alias("new_area"), old["_area"].alias("old_area"))

    def blocked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            numbers = [part.column(c).to_numpy() for c in ("seen", "new_area", "old_area")]
            way = hides(clipping.padded(part.column("v")), clipping.padded(part.column("p")), *numbers, least_visible, no_contains)
            yield part.select(["earlier", "later"]).filter(pa.array(way))

    ways = pairs.mapInArrow(blocked, StructType(pairs.schema.fields[:2]))
    taken, _ = taken_in_order(shown, ways, ident, [image, item])
    return candidates.join(taken.hint("merge"), ident)
