"""One-to-one assignment of point sets: nearest pairs first, as a loop over all pairs in order of distance would do it.

A pair that is the nearest of both its sides is in every such assignment. Each round takes all of them, removes what they
use by anti-joins, and goes on with the pairs that stay. Ties go by the two ids. Each round is staged.

The loop meets near pairs first, so the reach grows step by step: pairs within a small reach are settled, then those that
stay look further. A step's reach is chosen from counts by cells so that a set meets a few others; all pairs within the
full reach are never formed, unless so many sets lie in one place that no reach tells them apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.session import staged

#: Pairs that a step may look at for each set that is left.
PAIRS_A_SET = 24
#: Rows of one task of the joins, whose cells hold many pairs in few bytes.
TASK_ROWS = 1 << 16


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], ident: str, points: str, reach: float, closed: bool = False, tasks: int = 0) -> DataFrame:
    """(keys, left_id, right_id, distance) of all pairs of a key whose point sets have one size and a mean distance below
    ``reach`` (or at it, if ``closed``). The centres of two sets are never further apart than their points are in the
    mean, so sets meet in a grid of cells as wide as the reach: right ones in their own cell, left ones there and in the
    eight around. ``tasks``: of the join; by its bytes if 0."""
    at = lambda df, name: df.where((F.size(points) > 0)).select(*keys, F.col(ident).alias(name), F.col(points).alias(name + "_points"), G.center(F.col(points)).alias("_c"))
    cell = lambda c, d: F.floor(F.col("_c")[c] / reach) + d
    around = F.explode(F.array(*[F.struct(cell("x", i).alias("x"), cell("y", j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    l = at(left, "left_id").withColumn("_cell", around).withColumnRenamed("_c", "_d")  # noqa: E741
    r = at(right, "right_id").withColumn("_cell", F.struct(cell("x", 0).alias("x"), cell("y", 0).alias("y")))
    if tasks:
        l, r = l.repartition(tasks, *keys, "_cell"), r.repartition(tasks, *keys, "_cell")  # noqa: E741
    apart = (F.col("_c")["x"] - F.col("_d")["x"]) ** 2 + (F.col("_c")["y"] - F.col("_d")["y"]) ** 2
    met = l.join(r.hint("merge"), [*keys, "_cell"]).where((F.size("left_id_points") == F.size("right_id_points")) & ~(apart > (reach * 1.001) ** 2))
    met = met.select(*keys, "left_id", "right_id", G.mean_distance(F.col("left_id_points"), F.col("right_id_points")).alias("distance"))
    return met.where(F.col("distance") <= reach if closed else F.col("distance") < reach)


def mutual(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """pairs: (keys, left_id, right_id, distance). (keys, left_id, right_id, distance, round), each id once at most, and
    the number of rounds."""
    rest, found, rounds = staged(pairs, "pairs"), None, 0
    pair = F.struct("distance", "left_id", "right_id")
    while not rest.isEmpty():
        rounds += 1
        best = lambda side, rest=rest: rest.groupBy(*keys, side).agg(F.min(pair).alias("m")).select(*keys, "m.*")
        now = staged(best("left_id").join(best("right_id").hint("merge"), [*keys, "distance", "left_id", "right_id"], "left_semi"), "matched")
        rest = staged(_without(_without(rest, now, [*keys, "left_id"]), now, [*keys, "right_id"]).select(*pairs.columns), "pairs")
        now = now.select(*keys, "left_id", "right_id", "distance", F.lit(rounds).alias("round"))
        found = now if found is None else found.unionByName(now)
    return (found if found is not None else rest.withColumn("round", F.lit(0))), rounds


def _without(rows: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """By a sorted merge: ids compress so well that Spark would take millions of them for small enough to broadcast."""
    return rows.join(taken.select(*on).hint("merge"), on, "left_anti")


def step_reach(sets: DataFrame, keys: list[str], least: float, reach: float, budget: float) -> float:
    """A reach of at most ``reach`` and at least ``least``, within which about ``budget`` pairs or fewer meet. sets: (keys,
    _side 0 or 1, _x, _y). Pairs that meet in a grid are about those of one cell three times as wide."""
    now, before = reach, math.inf
    while now > least:
        cells = sets.groupBy(*keys, F.floor(F.col("_x") / (3 * now)).alias("_cx"), F.floor(F.col("_y") / (3 * now)).alias("_cy"))
        met = cells.agg(F.sum("_side").cast("double").alias("r"), F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum((F.col("n") - F.col("r")) * F.col("r"))).first()[0] or 0.0
        if met <= budget or met > 0.9 * before:
            return now
        now, before = max(least, now / 2.0 ** max(1, math.ceil(math.log(met / budget, 4)))), met
    return now


def assigned(left: DataFrame, right: DataFrame, keys: list[str], ident: str, points: str, reach: float, closed: bool = False) -> DataFrame:
    """(keys, left_id, right_id, distance, round): the one-to-one assignment of left to right point sets within a key."""
    c = G.center(F.col(points))
    held = lambda df, side: staged(df.where(F.size(points) > 0).select(*keys, F.col(ident), F.col(points), F.lit(side).alias("_side"), c["x"].alias("_x"), c["y"].alias("_y")), "sets")
    rest, found, rounds, now = {"left_id": held(left, 0), "right_id": held(right, 1)}, None, 0, 0.0
    while True:
        l, r = rest.values()  # noqa: E741
        places = l.select(*keys, "_side", "_x", "_y").unionByName(r.select(*keys, "_side", "_x", "_y"))
        rows = places.count()
        now = step_reach(places, keys, min(reach, 2 * now), reach, PAIRS_A_SET * max(rows, 4096))
        pairs = near_pairs(l, r, keys, ident, points, now, closed and now == reach, -(-9 * rows // TASK_ROWS))
        new, n = mutual(pairs, keys)
        new = new.withColumn("round", F.col("round") + rounds)
        rounds, found = rounds + n, new if found is None else found.unionByName(new)
        if now >= reach:
            return found
        if n:
            for side, sets in rest.items():
                rest[side] = staged(_without(sets, new.withColumnRenamed(side, ident), [*keys, ident]).select(*sets.columns), "sets")
